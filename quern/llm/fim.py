r"""Fill-in-middle transformation by injected markers. DataFrame operations only.

A delimiter is escaped in the text, and a regular expression appends it after every unit. Units are then counted by
counting delimiters, and any run of units is what lies between two ranks of the delimiter (substring_index). The parts
lose their delimiters, are unescaped and put together with sentinels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm.common import need, read

MARK, ESCAPE = "\x01", "\x02"
#: What a unit is, over escaped text: an escape and what follows is one character.
UNITS = {
    "character": f"(?s)({ESCAPE}[01]|.)",
    "word": "(?s)([^ \t-\r]+[ \t-\r]*|[ \t-\r]+)",
    "line": "(?s)([^\n]*\n|[^\n]+)",
}
SENTINELS = ("<P>", "<S>", "<M>")


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def marked(text: Column, unit: str = "character") -> Column:
    """The escaped text with a mark after each unit."""
    escaped = _replace(_replace(text, ESCAPE, f"{ESCAPE}0"), MARK, f"{ESCAPE}1")
    return F.regexp_replace(escaped, UNITS[unit], f"$1{MARK}")


def count_units(mark: Column) -> Column:
    return (F.octet_length(mark) - F.octet_length(_replace(mark, MARK, ""))).cast("long")


def _ranked(mark: Column, rank: Column) -> Column:
    return F.call_function("substring_index", mark, F.lit(MARK), rank.cast("int"))


def _plain(part: Column) -> Column:
    return _replace(_replace(_replace(part, MARK, ""), f"{ESCAPE}1", MARK), f"{ESCAPE}0", ESCAPE)


def parts(mark: Column, n: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """The first `low` units of a marked text, those up to the `high`-th, and the rest of its n."""
    middle = _ranked(_ranked(mark, high), low - high)
    return _plain(_ranked(mark, low)), _plain(middle), _plain(_ranked(mark, high - n - 1))


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed, colon and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, *, unit: str = "character", seed: str = "1", percent: int = 90, suffix_first: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm), prefix_units, middle_units, text (null as empty), output.

    Cuts are drawn from the document's id: `percent` of a hundred documents are cut, `suffix_first` of a hundred of those put
    the suffix first. Empty texts and those that contain a sentinel are plain: output is the text, and the two counts are
    null. All draws of rows without doc_id are those of the empty id. Very long texts are handled whole; their
    marked copy is about twice as long. Repeated rows are cut alike. An empty table gives no rows; other columns are ignored.
    """
    p, s, m = sentinels
    docs = need(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", "text", *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed), 1)])
    plain = (F.col("text") == "") | F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m)) | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "h1", "h2", form.alias("form"), marked(F.col("text"), unit).alias("mark"))
    rows = rows.select("doc_id", "text", "form", "mark", count_units(F.col("mark")).alias("n"), "h1", "h2")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "form", "mark", "n", F.least(one, two).alias("low"), F.greatest(one, two).alias("high"))
    prefix, middle, suffix = parts(F.col("mark"), F.col("n"), F.col("low"), F.col("high"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
        .otherwise(F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
    )
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, F.col("low")).alias("prefix_units"), F.when(cut, F.col("high") - F.col("low")).alias("middle_units"), "text", output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from an output and its form alone. Each sentinel occurs once in an output that isn't plain."""
    p, s, m = sentinels
    first, last = (lambda x, d: F.substring_index(x, d, 1)), (lambda x, d: F.substring_index(x, d, -1))
    middle = last(output, m)
    psm = F.concat(last(first(output, s), p), middle, last(first(output, m), s))
    spm = F.concat(last(first(output, m), p), middle, last(first(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_marker_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(read(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT *, least(a, b) AS low, greatest(a, b) AS high, substr(text, 1, least(a, b)) AS prefix,
         substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(text, greatest(a, b) + 1) AS suffix
  FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
