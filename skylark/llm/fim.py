"""Fill-in-middle transformation of whole texts, in Spark SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text of an output, told from its sentinels; no sentinel lies in a text that was rearranged."""
    last = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    first = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c: c.substr(F.lit(len(PREFIX) + 1), F.length(c))
    psm = F.concat(after(first(output, SUFFIX)), last, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), last, after(first(output, PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, *, seed: int = 1, rate: int = 90, spm_rate: int = 20, unit: str = "(?s).", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, restored: every whole text rearranged around its middle.

    A text is cut into the ``n`` units that ``unit`` matches from left to right; the pattern must match
    every character in some unit, by default each code point is one. The two cuts, the form and so all
    else follow from ``seed`` and the id: ``rate`` of 100 texts are rearranged, ``spm_rate`` of 100 of
    those with the suffix first. Texts that are empty or hold a sentinel stay plain, and their numbers
    of characters are null. ``restored`` is read back from ``output`` and ``form`` alone.

    A null text counts as empty, a null id as an empty one. Repeated rows give equal rows each; an
    empty table gives none; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    df = df.select("doc_id", "text", F.regexp_extract_all("text", F.lit(unit), F.lit(0)).alias("units"), *[h.alias(f"h{i}") for i, h in enumerate(draws(seed, F.col("doc_id")), 1)])
    n = F.size("units").cast("long")
    df = df.select("doc_id", "text", "units", n.alias("n"), *[(F.col(h) % (n + 1)).cast("int").alias(c) for h, c in (("h1", "a"), ("h2", "b"))], "h3", "h4")
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | held | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    df = df.select("doc_id", "text", "units", "n", form.alias("form"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    parts = [part(F.lit(1), F.col("a")), part(F.col("a") + 1, F.col("b") - F.col("a")), part(F.col("b") + 1, F.greatest(F.col("n").cast("int") - F.col("b"), F.lit(0)))]
    df = df.select("doc_id", "text", "n", "form", *[F.when(F.col("form") != "plain", x).alias(c) for x, c in zip(parts, ("prefix", "middle", "suffix"), strict=True)])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    df = df.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))
    return df.withColumn("restored", restored(F.col("output"), F.col("form")))


def digests(rows: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with the sha256 of both texts in place of them."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
