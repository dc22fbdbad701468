import pyarrow as pa

from threadlake.llm import frames


def test_functions_get_parts_of_bounded_size(spark, documents):
    rows = [(i, "ab" * (i % 7) * 75_000) for i in range(40)] + [(40, None), (41, ""), (42, "x" * 6_000_000)]
    docs = documents(rows).coalesce(1)

    def sizes(texts: pa.Array) -> list[pa.Array]:
        given = sum(len(t or "") for t in texts.to_pylist())
        return [pa.array([given] * len(texts)), pa.array([len(t or "") for t in texts.to_pylist()])]

    out = frames.add_columns(docs, sizes, ["text"], "given bigint, own bigint", ("text",)).collect()
    assert {r.doc_id: r.own for r in out} == {i: len(t or "") for i, t in rows}
    assert len(out) == len(rows)
    assert all(r.given <= max(frames.PART_BYTES, r.own) for r in out)
    assert len({r.given for r in out}) > 1
