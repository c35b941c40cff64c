"""Chunks of a document: by headings, and plain text by paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprov.functions.text import sha256, token_estimate, trimmed, word_count
from docprov.functions.watermark import stripped

MIN_WORDS = 75
BLANK = r"[ \t\x0B\f\r]+"


def heading_chunks(docs: DataFrame, key: str = "doc_id", body: str = "body", title: Column | None = None) -> DataFrame:
    """(key, sequence, section_title, heading_level, content, content_hash, token_count,
    heading_path): sections start at second- and third-level headings; what stands before
    the first belongs to the document's title, and so do third-level sections below a
    second-level heading equal to it. A section without text goes; a short one without a
    heading joins the one before it. All within the row: nothing is shuffled."""
    title = F.lit("Document") if title is None else title

    def below(part: Column) -> Column:
        second = trimmed(F.regexp_extract(part, rf"\A##{BLANK}([^\r\n]+)", 1))
        return F.transform(F.split(part, rf"(?m)(?=^###{BLANK}[^\r\n]+)"), lambda p: F.struct(trimmed(p).alias("content"), second.alias("second")))

    parts = F.flatten(F.transform(F.split(F.col(body), rf"(?m)(?=^##{BLANK}[^\r\n]+)"), below))
    rows = docs.select(key, title.alias("title"), F.filter(parts, lambda x: x.content != "").alias("parts"))
    joins = lambda x, i: (i > 0) & ~x.content.rlike(r"\A###?\s+") & (word_count(x.content) < MIN_WORDS)
    rows = rows.withColumn("starts", F.filter(F.transform("parts", lambda x, i: F.when(joins(x, i), -1).otherwise(i)), lambda i: i >= 0))

    def section(start: Column, k: Column) -> Column:
        upto = F.coalesce(F.get("starts", k + 1), F.size("parts"))
        content = F.array_join(F.transform(F.slice("parts", start + 1, upto - start), lambda x: x.content), "\n\n")
        return F.struct(content.alias("content"), F.get("parts", start).alias("first"))

    rows = rows.select(key, "title", F.transform("starts", section).alias("sections"))
    # Outer, as a filter for empty arrays would be pushed down with all of the above in it, and work it out again.
    rows = rows.select(key, "title", F.posexplode_outer("sections").alias("sequence", "section")).where("section is not null").select(key, "title", "sequence", "section.content", F.col("section.first.second").alias("second"), F.col("section.first.content").alias("first"))
    head = rf"\A(###?){BLANK}([^\r\n]+)"
    out = rows.select(key, "title", "sequence", "content", "second", F.regexp_extract("first", head, 1).alias("mark"), trimmed(F.regexp_extract("first", head, 2)).alias("own"))
    inner = (F.col("second") != "") & (F.col("second") != F.col("title"))
    path = F.when(F.col("mark") == "", F.array("title")).when((F.col("mark") == "##") | ~inner, F.array("title", "own")).otherwise(F.array("title", "second", "own"))
    return out.select(
        key,
        "sequence",
        F.when(F.col("mark") == "", F.col("title")).otherwise(F.col("own")).alias("section_title"),
        F.when(F.col("mark") == "###", 3).otherwise(2).alias("heading_level"),
        "content",
        sha256(F.col("content")).alias("content_hash"),
        token_estimate(F.col("content")).alias("token_count"),
        path.alias("heading_path"),
    )


def crosswalk_chunks(docs: DataFrame, key: str = "doc_id", body: str = "body") -> DataFrame:
    return heading_chunks(docs, key, body, F.lit("Crosswalk"))


def rechunked(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks without marks, hashed and numbered anew."""
    w = Window.partitionBy(key).orderBy("sequence")
    bare = chunks.withColumn("content", stripped(F.col("content")))
    return bare.withColumn("content_hash", sha256(F.col("content"))).withColumn("sequence", F.row_number().over(w) - 1)


def source_chunks(text: Column, target: int = 8000, most: int = 12000) -> Column:
    """An array of strings: paragraphs packed up to `target` characters, never over `most`
    unless a paragraph must be cut. One fold over the paragraphs."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), trimmed), lambda p: p != "")

    def step(acc: Column, p: Column) -> Column:
        flushed = F.when(acc.now == "", acc.out).otherwise(F.concat(acc.out, F.array(acc.now)))
        size = F.length(acc.now) + F.when(acc.now == "", 0).otherwise(2) + F.length(p)
        full = (acc.now != "") & ((size > most) | ((F.length(acc.now) >= target) & (size > target)))
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
        big = F.length(p) >= most
        out = F.when(big, F.concat(flushed, slices)).when(full, flushed).otherwise(acc.out)
        now = F.when(big, F.lit("")).when(full | (acc.now == ""), p).otherwise(F.concat(acc.now, F.lit("\n\n"), p))
        return F.struct(out.alias("out"), now.alias("now"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))
    done = F.aggregate(paragraphs, start, step, lambda acc: F.when(acc.now == "", acc.out).otherwise(F.concat(acc.out, F.array(acc.now))))
    return F.when(F.size(paragraphs) == 0, F.array(text)).otherwise(done)


def word_sections(text: Column, target_words: int = 1200) -> Column:
    """Markdown of numbered sections of about `target_words` words, each named after its beginning."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), trimmed), lambda p: p != "")

    def section(acc: Column) -> Column:
        preview = trimmed(F.substring(F.regexp_replace(F.get(acc.now, F.lit(0)), r"\A#+\s+", ""), 1, 80))
        head = F.concat(F.lit("## Section "), (F.size(acc.out) + 1).cast("string"), F.when(preview != "", F.concat(F.lit(" — "), preview)).otherwise(F.lit("")))
        return F.when(F.size(acc.now) == 0, acc.out).otherwise(F.concat(acc.out, F.array(F.concat(head, F.lit("\n\n"), F.array_join(acc.now, "\n\n")))))

    def step(acc: Column, p: Column) -> Column:
        n = word_count(p)
        full = (acc.n > 0) & (acc.n + n > target_words)
        out = F.when(full, section(acc)).otherwise(acc.out)
        now = F.when(full, F.array(p)).otherwise(F.concat(acc.now, F.array(p)))
        return F.struct(out.alias("out"), now.alias("now"), (F.when(full, F.lit(0).cast("long")).otherwise(acc.n) + n).alias("n"))

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("now"), F.lit(0).cast("long").alias("n"))
    return F.when(F.size(paragraphs) == 0, F.lit("## Section 1\n\nNo content extracted.")).otherwise(F.array_join(F.aggregate(paragraphs, start, step, section), "\n\n"))
