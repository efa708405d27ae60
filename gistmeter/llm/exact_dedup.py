"""Exact duplicates by content-defined chunk recipes, with SQL functions only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmeter.llm.shared import text_documents, written

BLANK = r"[\x20\x09-\x0D]+"
# A cut falls behind three bytes of fixed residues, so an insertion moves only the cuts next to it.
# Bytes are seen as Latin-1 characters: the rule is the same for every script.
SMALLEST, LARGEST = 512, 8192


def _residue(modulus: int, rest: int) -> str:
    return "[" + "".join(f"\\x{b:02X}" for b in range(rest, 256, modulus)) + "]"


CUT = _residue(8, 1) + _residue(8, 6) + _residue(8, 4)
CHUNK = f"(?s).{{{SMALLEST},{LARGEST}}}?{CUT}|.{{1,{LARGEST}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def chunks(norm: Column) -> Column:
    """The text's bytes in content-defined chunks of at most LARGEST + 3 bytes; none for an empty text."""
    return F.regexp_extract_all(F.decode(F.encode(norm, "UTF-8"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, fingerprint=F.xxhash64) -> DataFrame:
    """(doc_id, row, points, text_sha256, recipe): a document as the ordered fingerprints of its chunks."""
    norm = text_documents(docs).select("doc_id", F.xxhash64("text").alias("row"), F.char_length("text").alias("points"),
                                       normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", "row", "points", F.sha2("norm", 256).alias("text_sha256"),
                       F.transform(chunks(F.col("norm")), lambda c: fingerprint(c)).alias("recipe"))


def chunk_table(docs: DataFrame, fingerprint=F.xxhash64) -> DataFrame:
    """(fp, chunk, uses): every distinct chunk once.  Grouping by the bytes themselves, after a partial
    count in each task, is what verifies a fingerprint: two rows of one fp are a clash."""
    cut = text_documents(docs).select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
    return cut.groupBy(fingerprint("chunk").alias("fp"), "chunk").agg(F.count(F.lit(1)).alias("uses"))


def verified_recipes(docs: DataFrame, fingerprint=F.xxhash64) -> DataFrame:
    """Recipes with verified identifiers: fp, and `twins`, which tells chunks of one fp apart.

    `twins` is empty unless a document holds a chunk whose fp another chunk has too; such documents
    alone are read again, and their clashing chunks numbered by their bytes.
    """
    base = written(recipes(docs, fingerprint), "recipes")
    clash = written(chunk_table(docs, fingerprint).groupBy("fp").count().filter("count > 1").select("fp"), "clashes")
    if clash.isEmpty():
        return base.withColumn("twins", F.lit(""))
    holders = base.select("row", F.explode("recipe").alias("fp")).join(clash, "fp", "left_semi").select("row").distinct()
    placed = (text_documents(docs).withColumn("row", F.xxhash64("text")).join(holders, "row", "left_semi")
              .select("doc_id", "row", F.posexplode(chunks(normalised(F.col("text")))).alias("pos", "chunk"))
              .withColumn("fp", fingerprint("chunk")).join(clash, "fp", "left_semi"))
    numbered = placed.select("fp", "chunk").distinct().withColumn(
        "twin", F.row_number().over(Window.partitionBy("fp").orderBy("chunk")))
    twins = (placed.join(numbered, ["fp", "chunk"]).groupBy("doc_id", "row")
             .agg(F.to_json(F.array_sort(F.collect_set(F.struct("pos", "twin")))).alias("twins")))
    same = (base["row"] == twins["row"]) & base["doc_id"].eqNullSafe(twins["doc_id"])
    return base.join(twins, same, "left").select(base["*"], F.coalesce(twins["twins"], F.lit("")).alias("twins"))


def exact_duplicates(docs: DataFrame, fingerprint=F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`.

    Texts are equal when they are once blanks are deleted; a null text is empty, and all empty texts are
    equal.  The row with the most code points stays, then the one with the smallest doc_id; a null doc_id
    comes last.  Rows that repeat a doc_id count in group_size and are kept or dropped together.  Other
    columns are ignored.  An empty table gives an empty result.

    Texts are cut where they are read: distinct chunks alone are moved, once, to be verified.  Groups are
    found and joined on the narrow lists; the join has one row per group on one side, so Spark splits the
    other side of a large group over tasks.
    """
    rows = verified_recipes(docs, fingerprint).withColumn("digest", F.xxhash64("recipe", "twins"))
    key = ["digest", "recipe", "twins"]
    # ~ turns the order of ids round without an overflow
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("back")))
    groups = rows.groupBy(*key).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    joined = rows.join(groups.select(*key, F.bitwise_not("best.back").alias("keep_id"), "group_size"), key)
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
