"""Exact copies, found by comparing recipes of content-defined chunks.

A text, white space runs replaced by one space, is cut where its own content says so:
after four characters in a row that belong to four sets of about a fifth of all
characters, `LEAST` characters after the last cut at the earliest and `MOST` at the
latest. Texts that share a passage mostly share its chunks, wherever it stands. Chunks
are deduplicated: each distinct chunk moves once from a task, and a 64-bit hash stands
for it if no other chunk has it; hashes that several chunks have are told from the
chunks themselves and numbered, so that an identifier is only ever one chunk. A
text's recipe is the list of its chunks' identifiers in order, and texts are equal if
and only if their recipes are. Only recipes are grouped and joined, a hundredth of the
text; documents stay where they are.

Defined cases: a null text is empty, and all empty texts are equal (their recipe is
empty); of rows that repeat an id and a text, one stays; a row with a null id comes
after all ids, so it only stays where no equal text has one, and its group's keep_id
is null then; very long texts have more chunks, never longer ones; an empty table gives
no rows; other columns, of clashing names too, are dropped by `exact_copies` and kept
by `without_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlens.llm.common import table, whole_text, written

#: Characters in a chunk.
LEAST, MOST = 256, 8192
#: Bits of a chunk's hash. Tests take few, so that chunks share hashes.
HASH_BITS = 64


def character_set(number: int) -> str:
    """About a fifth of the characters of any script, another fifth for each number below five."""
    latin = "".join(f"\\x{c:02x}" for c in range(0x20, 0x180) if c < 0x100 and (c * 7 + c // 5) % 5 == number)
    wide = "".join(f"\\u{c:04x}-\\u{c + 0x33:04x}" for c in range(0x100 + number * 0x33, 0x600, 0xFF))
    far = "".join(f"\\u{c:04x}-\\u{c + 0x332:04x}" for c in range(0x0600 + number * 0x333, 0xD7FF - 0x333, 0x0FFF))
    return f"[{latin}{wide}{far}]"


CHUNK = f"(?s).{{{LEAST},{MOST}}}?(?<={''.join(map(character_set, range(4)))})|(?s).{{1,{MOST}}}"


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def chunks(text: Column) -> Column:
    """The chunks of a text in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def hashed(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits >= 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def shared_hashes(texts: DataFrame, bits: int) -> DataFrame:
    """(_hash, _chunk, _number): the chunks whose hash another chunk has too, numbered within the hash; mostly none."""
    each = texts.select(F.explode(chunks(F.col("_text"))).alias("_chunk"))
    distinct = each.groupBy(hashed(F.col("_chunk"), bits).alias("_hash"), "_chunk").agg(F.lit(1).alias("_one"))
    shared = written(distinct.groupBy("_hash").agg(F.sum("_one").alias("_n")).filter("_n > 1").select("_hash"))
    if shared.isEmpty():
        return shared.select("_hash", F.lit("").alias("_chunk"), F.lit(1).alias("_number"))
    both = each.withColumn("_hash", hashed(F.col("_chunk"), bits)).join(shared, "_hash", "left_semi").distinct()
    return written(both.withColumn("_number", F.row_number().over(Window.partitionBy("_hash").orderBy("_chunk"))))


def recipes(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """(_row, key, text_sha256, _recipe): a written row for each document; `_recipe` holds a verified identifier for each chunk."""
    texts = docs.select(F.col(key).alias("_key"), one_space(whole_text(text)).alias("_text"))
    listed = F.transform(chunks(F.col("_text")), lambda c: hashed(c, bits))
    plain = texts.select(F.monotonically_increasing_id().alias("_row"), "_key", F.sha2("_text", 256).alias("text_sha256"), F.transform(listed, lambda h: F.struct(h.alias("hash"), F.lit(1).alias("number"))).alias("_recipe"), "_text")
    shared = shared_hashes(texts, bits)
    if shared.isEmpty():
        return written(plain.drop("_text"))
    # identifiers of chunks that share a hash: by the chunk itself, a row for each place of such a hash only
    plain = written(plain)
    places = plain.select("_row", F.posexplode(chunks(F.col("_text"))).alias("_place", "_chunk")).withColumn("_hash", hashed(F.col("_chunk"), bits))
    numbered = places.join(shared, ["_hash", "_chunk"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_number"))).alias("_numbers"))
    number = lambda x, i: F.coalesce(F.col("_numbers")[i], x["number"])
    told = plain.drop("_text").join(numbered, "_row", "left")
    exact = F.transform("_recipe", lambda x, i: F.struct(x["hash"].alias("hash"), number(x, i).alias("number")))
    return written(told.withColumn("_recipe", F.when(F.col("_numbers").isNull(), F.col("_recipe")).otherwise(exact)).drop("_numbers"))


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = HASH_BITS) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256, n_chunks) of every row of `docs`."""
    return judged(recipes(docs, key, text, bits)).select(F.col("_key").alias(key), "keep_id", "group_size", "kept", "text_sha256", "n_chunks")


def judged(rows: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("_key").isNull().alias("no_key"), F.col("_key").alias("key"), F.col("_row").alias("row")))
    groups = written(rows.groupBy("_recipe").agg(first.alias("_first"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    found = rows.join(groups, "_recipe", "left")
    alone = F.col("_first").isNull()
    return found.select(
        "_row",
        "_key",
        F.when(alone, F.col("_key")).otherwise(F.col("_first.key")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("_first.row") == F.col("_row"))).alias("kept"),
        "text_sha256",
        F.size("_recipe").cast("bigint").alias("n_chunks"),
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts."""
    place = "_" * (1 + max(map(len, docs.columns), default=0))
    numbered = written(docs.withColumn(place, F.monotonically_increasing_id()))
    gone = exact_copies(numbered.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(place).alias("place")).alias("key"), F.col(text).alias("text")), "key")
    return numbered.join(written(gone.filter(~F.col("kept")).select(F.col("key.place").alias(place))), place, "left_anti").select(*docs.columns)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op13_exact_dedup": """
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS s FROM documents),
    g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM t JOIN g USING (s)
    """
}
