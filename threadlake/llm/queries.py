"""One query per operator: its production settings over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import (
    chat,
    fill_middle,
    language,
    main_text,
    near_duplicates,
    packing,
    piece_lattice,
    pii,
    quality,
    threshold_search,
    turn_repair,
    warc,
    word_model,
)
from threadlake.llm.frames import table
from threadlake.scratch import Scratch


def op1_recurrent_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from the labelled ones that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    found = language.identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op2_perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    """Every dialogue from the seat of each participant, one row per turn."""
    turns = table(spark, folder, "conversations")
    return chat.rotate_perspectives(turns, Scratch(spark, "chat"))


def op3_bag_min_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document: five-word shingles, similarity of 0.8 or more."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates.near_duplicates(docs, Scratch(spark, "near-duplicates"))


def op4_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and the verdict of the fitted label model for every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = Scratch(spark, "quality").write(quality.with_counts(docs, keep_text=False), "counts")
    judged = quality.judge(counted, quality.fit(counted))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "quality",
    )


def op5_tree_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return main_text.extract(pages, keep_html=False).select("page_id", "url", "text", "n_chars")


def op6_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives, and its record as read back from them."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    path = Scratch(spark, "warc").folder("archives")
    warc.write_archives(warc.plan_records(pages), path)
    return warc.read_archives(spark, path, keep_payload=False).drop("payload")


def op7_n_best_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The three best segmentations of every document into the pieces of a public model."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return piece_lattice.encode(docs, piece_lattice.load(), keep_text=False)


def op8_threshold_algorithm(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector by integer inner product."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return threshold_search.search(vectors, F.col("vec_id") % 50 == 0, Scratch(spark, "top-k"))


def op9_conflict_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every document in sequences of 2,048 words, by source and duplicate cluster."""
    sized = packing.with_sizes(table(spark, folder, "documents"))
    sized = Scratch(spark, "packing").write(sized, "sized")
    return packing.pack(sized)


def op10_information_sanitising(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data and of revealing terms in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.sanitise(docs, Scratch(spark, "pii"), keep_text=False)
    return found.select("doc_id", *pii.digest(found))


def op11_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document under the restaurant model of six in seven of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    learns = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    settings = word_model.Settings(whole=True)
    return word_model.score(docs, learns, Scratch(spark, "word-model"), settings=settings)


def op12_block_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation damaged by rule, then repaired at least cost."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    repaired = turn_repair.repair(turn_repair.damage(turns), Scratch(spark, "turn-repair"))
    return turn_repair.digest(*repaired, turns)


def op13_repeated_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut between lines into prefix, middle and suffix, and rebuilt."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = fill_middle.rearrange(docs)
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(), 256).alias("restored_sha256"),
    )
