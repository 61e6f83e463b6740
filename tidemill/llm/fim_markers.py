"""Fill-in-middle transformation by escaped marker injection, in Spark's own string functions.

A delimiter that may itself occur in texts is escaped first.  A regular expression then puts the
delimiter behind every unit (a code point, or whatever ``unit`` matches), so units can be counted by
counting delimiters, and the part before, between or behind two ranks is a ``substring_index``.  Parts
lose their delimiters, are unescaped, and are put together around the sentinels.  Nothing is shuffled
and no row leaves the JVM; a task holds one row at a time.

The cuts come from sha256 of seed and id, so they don't depend on partitions or order.

Defined results: a null or empty text has no units and stays plain (an empty string); a text that
holds a sentinel stays plain, since it could not be taken apart again; a null id hashes as an empty
one; equal ids have equal hashes, whatever their texts; a long text counts whole and needs some three
times its size in a task; repeated rows get equal results; an empty table gives an empty one; input
columns travel in the struct ``row`` and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Behind each unit stands MARK; ESCAPE "1" and ESCAPE "2" stand for the two characters themselves.
MARK, ESCAPE = "\x01", "\x02"
#: One code point.  A unit never starts inside an escaped character.
CODE_POINT = f"{ESCAPE}[12]|[^{ESCAPE}]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}2")), F.lit(MARK), F.lit(f"{ESCAPE}1"))


def unescaped(part: Column) -> Column:
    """The text of a part: without its marks, and with what they stood for."""
    bare = F.replace(part, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(f"{ESCAPE}1"), F.lit(MARK)), F.lit(f"{ESCAPE}2"), F.lit(ESCAPE))


def marked(text: Column, unit: str = CODE_POINT) -> Column:
    """The escaped text with a mark behind every unit."""
    return F.regexp_replace(escaped(text), f"(?s)({unit})", f"$1{MARK}")


def draws(seed: int, key: Column) -> list[Column]:
    """Four unsigned 32-bit integers from sha256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _index(text: Column, mark: Column, count: Column) -> Column:
    return F.call_function("substring_index", text, mark, count.cast("int"))


def fill_in_middle(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    seed: int = SEED,
    plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW,
    unit: str = CODE_POINT,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """Each input row as ``row`` (without its text) with n, form (plain, psm or spm), prefix, middle, suffix and output.

    Prefix, middle and suffix are null where the form is plain; the output is then the text.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*others).alias("row"), text.alias("text"), marked(text, unit).alias("marked"), *[d.alias(f"h{i}") for i, d in enumerate(draws(seed, F.col(id_col)), 1)])
    # a mark is one byte
    rows = rows.withColumn("n", (F.octet_length("marked") - F.octet_length(F.replace("marked", F.lit(MARK), F.lit("")))).cast("long"))
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    rows = rows.withColumns({"_a": F.least(*cuts), "_b": F.greatest(*cuts)})
    holds = F.contains("text", F.lit(sentinels[0])) | F.contains("text", F.lit(sentinels[1])) | F.contains("text", F.lit(sentinels[2]))
    form = F.when((F.col("text") == "") | holds | (F.col("h3") % 100 >= plain_from), "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    mark, cut = F.lit(MARK), F.col("form") != "plain"
    head = _index(F.col("marked"), mark, F.col("_b"))
    parts = {
        "prefix": _index(F.col("marked"), mark, F.col("_a")),
        "middle": _index(head, mark, F.col("_a") - F.col("_b")),
        "suffix": _index(F.col("marked"), mark, F.col("_b") - F.col("n") - 1),
    }
    rows = rows.withColumn("form", form).withColumns({name: F.when(cut, unescaped(part)) for name, part in parts.items()})
    p, s, m = (F.lit(x) for x in sentinels)
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    return rows.select("row", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text behind an output: its parts in their first order.  Sentinels share no border, so no cut can make one."""
    p, s, m = (F.lit(x) for x in sentinels)
    between = lambda left, right: _index(_index(output, right, F.lit(1)), left, F.lit(-1))
    middle = _index(output, m, F.lit(-1))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = fill_in_middle(docs)
    return done.select(
        F.col("row.doc_id").alias("doc_id"), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


_DRAW = "CAST('0x' || substr(d, {}, 8) AS BIGINT)"

OP12_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, length(text) AS n, {_DRAW.format(1)} AS h1, {_DRAW.format(9)} AS h2, {_DRAW.format(17)} AS h3, {_DRAW.format(25)} AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
    WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
    WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM c"""
