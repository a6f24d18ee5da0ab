"""The registered queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.io import ensure_checkpoint_dir, table
from tracewell.llm import encoding, garbled, lookalikes, packing, personal, residue, splitting


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id) of responses whose body has garbled text."""
    return garbled.garbled_bodies(_read(spark, sf_dir, "har_responses"), "entry_id", "text", "encoding", "mimetype")


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, body) of these responses, with the original characters where they can be had."""
    return garbled.garbled_bodies(_read(spark, sf_dir, "har_responses"), "entry_id", "text", "encoding", "mimetype", "body")


def _personal(spark: SparkSession, sf_dir: str, redacted: str | None = None) -> DataFrame:
    small = (_read(spark, sf_dir, name) for name in ("name_lexicon", "pii_kinds"))
    return personal.personal_items(_read(spark, sf_dir, "har_responses"), "entry_id", "text", "encoding", "mimetype", *small, redacted)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, kind, start_pos) of personal items in bodies."""
    return _personal(spark, sf_dir)


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, body): every response's body with its items replaced."""
    return _personal(spark, sf_dir, "body")


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_bodies(_read(spark, sf_dir, "har_responses"), "entry_id", "text", "encoding", "mimetype")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id) of response bodies and mapping statuses that are leftovers, not content."""
    bodies = _residue(spark, sf_dir).select(F.lit("har_responses").alias("tbl"), F.col("entry_id").alias("row_id"))
    rows = _read(spark, sf_dir, "url_mapping").filter(residue.is_residue_status(F.col("status")))
    return bodies.unionByName(rows.select(F.lit("url_mapping").alias("tbl"), F.col("seq").alias("row_id")))


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id) of the responses that stay."""
    rows = _read(spark, sf_dir, "har_responses").select("entry_id")
    return residue.without_residue(rows, "entry_id", _residue(spark, sf_dir))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, piece_no, start_pos, end_pos, n_pieces, piece) of bodies over the limit."""
    return splitting.split_items(_read(spark, sf_dir, "har_responses"), "entry_id", "text", encoding="encoding", mimetype="mimetype")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id) of the bodies that the splitter cut."""
    return p5_pieces(spark, sf_dir).filter("piece_no = 2").select("entry_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encoding.encode_corpus(_read(spark, sf_dir, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece_no, offset, n, container): every document's ids in containers of 2,048."""
    ensure_checkpoint_dir(spark)
    sizes = encoding.encode_corpus(_read(spark, sf_dir, "documents"), "doc_id", "text", lengths_only=True).checkpoint()
    return packing.pack(sizes, "doc_id", "n_ids")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id_a, doc_id_b): documents that read the same and have other characters."""
    return lookalikes.lookalike_pairs(_read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, n_texts, n_links): documents with a look-alike, one row each."""
    return lookalikes.lookalike_classes(_read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, form): the consistent form of every document."""
    return lookalikes.normalise(_read(spark, sf_dir, "documents"), "doc_id", "text", "form")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_repaired, p3_found, p3_redacted, p4_found, p4_kept, p5_found, p5_pieces, p6_ids, p7_containers, p8_found, p8_classes, p8_forms)
}
ORACLE: dict[str, str] = {}
