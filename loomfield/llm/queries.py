"""The queries of problems 2 and 4 to 9, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import confusables, docpairs, mixing, origins, packing, secrets, splitting, tokens
from loomfield.session import checkpointed, spread, table


def limits(spark: SparkSession, folder: str) -> dict[str, tuple[int, int]]:
    """max_size and overlap_size by limit_name: a fixed table of four rows."""
    return {r["limit_name"]: (r["max_size"], r["overlap_size"]) for r in table(spark, folder, "size_limits").collect()}


def split_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every oversized text of the three tables."""
    of = limits(spark, folder)

    def items(df: DataFrame, name: str, key: str, section, text, limit: str) -> DataFrame:
        size, again = of[limit]
        return df.select(F.lit(name).alias("item_table"), F.col(key).cast("bigint").alias("item_id"), section.cast("int").alias("section_no"), text.alias("text"), F.lit(size).cast("bigint").alias("max_size"), F.lit(again).cast("bigint").alias("overlap_size"))

    pages = items(table(spark, folder, "pdf_pages"), "pdf_pages", "page_id", F.lit(0), F.col("page_text"), "pdf_page")
    code = items(table(spark, folder, "hop1_context"), "hop1_context", "hop_id", F.lit(0), F.col("code"), "hop1_code")
    sections = table(spark, folder, "docx_artifacts").select("docx_id", F.posexplode("sections").alias("at", "section"))
    docx = items(sections, "docx_artifacts", "docx_id", F.col("at") + 1, F.col("section.body_text"), "docx_section")
    return splitting.pieces(pages.unionByName(docx).unionByName(code), ["item_table", "item_id", "section_no"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that had to be split: those of which there is a first piece."""
    return split_pieces(spark, folder).where("piece_no = 1").select("item_table", "item_id", "section_no")


def secret_items(spark: SparkSession, folder: str) -> DataFrame:
    code = table(spark, folder, "hop1_context").select(F.lit("hop1_context").alias("item_table"), F.col("hop_id").alias("item_id"), F.col("code").alias("text"))
    evidence = table(spark, folder, "query_evidence").select(F.lit("query_evidence").alias("item_table"), F.col("evidence_id").alias("item_id"), F.col("content_text").alias("text"))
    return code.unionByName(evidence)


def p4_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with a credential, masked."""
    return secrets.scan(secret_items(spark, folder), ["item_table", "item_id"]).select("item_table", "item_id", F.size("lines").alias("n_lines"), F.array_join("kinds", ",").alias("kinds"), "masked_text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines on which a credential starts."""
    return secrets.scan(secret_items(spark, folder), ["item_table", "item_id"]).select("item_table", "item_id", F.explode("lines").alias("line_no"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documented functions by window and name."""
    return docpairs.documented(table(spark, folder, "hop1_context"), ["hop_id"]).select("hop_id", "func_name").distinct()


#: A description used for so many functions of the corpus, apart from their names, describes none of them.
MOST_USES = 25


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Function text with its documentation, without descriptions that the corpus repeats and without repeated pairs."""
    found = checkpointed(docpairs.documented(table(spark, folder, "hop1_context"), ["hop_id"], body=True))
    kept = docpairs.without_templates(found, MOST_USES)
    once = kept.groupBy(F.xxhash64("func_text", "doc_text").alias("pair")).agg(F.min("hop_id").alias("hop_id"))
    return kept.withColumn("pair", F.xxhash64("func_text", "doc_text")).join(once, ["pair", "hop_id"], "left_semi").select("hop_id", "func_name", "line_no", "doc_text", "func_text")


def p6_origins(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with its origin and what told it."""
    return origins.origins(table(spark, folder, "served_surfaces").select("file_path"), table(spark, folder, "verification_surfaces").select("file_path", "workspace_id", "code"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that nobody wrote by hand."""
    return p6_origins(spark, folder).where("origin <> 'hand-written'").select("file_path")


def sized_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents, written once for the plans that need sums before rows."""
    return checkpointed(tokens.counted(table(spark, folder, "documents"), ["doc_id", "source"]))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document, and of each piece of those above the capacity."""
    capacity = limits(spark, folder)["pack_container"][0]
    return packing.packed(sized_documents(spark, folder), "doc_id", "n_tokens", capacity)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by length: how many, and what part of them is used."""
    each = p7_packed(spark, folder).groupBy("container_id").agg(F.first("container_length").alias("container_length"), F.sum("piece_size").alias("used"), F.count("*").alias("items"))
    return each.groupBy("container_length").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("used_tokens"), F.round(F.sum("used") / F.sum("container_length"), 6).alias("fill"))


def mix_targets(spark: SparkSession, folder: str) -> dict[str, tuple[float, int]]:
    """A fixed table of a row a source."""
    return {r["source_name"]: (r["target_share"], r["max_repeats"]) for r in table(spark, folder, "mix_targets").collect()}


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents drawn, with their repeats."""
    counted = tokens.counted(table(spark, folder, "documents"), ["doc_id", "source"])
    return mixing.mixed(counted, mix_targets(spark, folder))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The actual share of each source."""
    out = mixing.shares(p8_mix(spark, folder), table(spark, folder, "mix_targets"))
    return out.withColumns({c: F.round(c, 9) for c in ("actual_share", "off_by")})


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that read the same and differ in characters."""
    return confusables.pairs(table(spark, folder, "documents"), "doc_id")


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each document that reads like one of other characters, with its class."""
    return confusables.classes(table(spark, folder, "documents"), "doc_id")


def p9_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every document."""
    return confusables.consistent(spread(table(spark, folder, "documents").select("doc_id", "text")), "text", "form_text", "confusable_kind").withColumn("changed", ~F.col("text").eqNullSafe(F.col("form_text"))).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p2_found, split_pieces, p4_found, p4_masked, p5_found, p5_pairs, p6_found, p6_origins, p7_packed, p7_containers, p8_mix, p8_shares, p9_found, p9_classes, p9_forms)
    return {("p2_pieces" if f is split_pieces else f.__name__): f for f in found}
