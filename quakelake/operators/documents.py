"""Documents to sections, chunks, statistics and keyword lists; text search.

A document table has ``doc_id`` and ``text`` (whole texts). Sectioning and chunking look at one
document at a time and need no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelake.functions import text as X
from quakelake.operators.common import exploded, top_k

# --- sections -----------------------------------------------------------------------------------


def _explode_sections(df: DataFrame, sections: Column, id_col: str) -> DataFrame:
    return exploded(df, [id_col], sections, "text", "page")


def markdown_sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _explode_sections(df, X.markdown_sections(F.col(text_col)), id_col)


def text_pages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_size: int = 2000
) -> DataFrame:
    return _explode_sections(df, X.text_pages(F.col(text_col), page_size), id_col)


def paper_sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    return exploded(df, [id_col], X.paper_sections(F.col(text_col), whole), "s", "section").select(
        id_col,
        "section",
        "s.title",
        "s.content",
        F.col("s.level").cast("long").alias("level"),
    )


# reStructuredText marks.
RST_UNDERLINE = r"^[=\-~^\"'#+*.]{3,}\s*$"
RST_DIRECTIVE = r"^\s*\.\.\s+\S"
RST_ROLE = r":\w+:`([^`]*)`"
RST_QUOTED = r"`+([^`]+)`+"


def rst_section_texts(text: Column) -> Column:
    """Section texts of one reStructuredText document, markup removed, as an array.

    Every line gets a letter: ``h`` heading, ``u`` its underline, ``d`` directive, ``i`` indented or
    empty, ``n`` other. Patterns over the string of letters then tell which lines go: the line after
    a heading, and a directive with the indented lines that follow it.
    """
    rows = X.lines(text)
    return _rst_found(_rst_pieces(_rst_marked(rows, _rst_letters(rows, _rst_below(rows)))), text)


def _rst_below(rows: Column) -> Column:
    return F.concat(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), F.array(F.lit("")))


def _rst_letters(rows: Column, below: Column) -> Column:
    def letter(line: Column, after: Column) -> Column:
        title = X.strip(line)
        # The pattern is tried last: few lines have one below that is long enough.
        underlined = (F.length(after) >= 3) & (title != "") & (F.length(X.strip(after)) >= F.length(title)) & after.rlike(RST_UNDERLINE)
        return (
            F.when(underlined, "h")
            .when(F.contains(line, F.lit("..")) & line.rlike(RST_DIRECTIVE), "d")
            .when((line == "") | line.rlike("^" + X.SPACE_CLASS), "i")
            .otherwise("n")
        )

    letters = F.array_join(F.zip_with(rows, below, letter), "")
    letters = F.regexp_replace(letters, "h.", "hu")
    # An indented line goes if the line before it went; the first letter stands before all lines.
    letters = F.regexp_replace(F.concat(F.lit("n"), letters), r"d|(?<!^)\Gi", "u")
    return F.split(F.substring(letters, 2, 2**31 - 1), "")


def _rst_marked(rows: Column, letters: Column) -> Column:
    def plain(line: Column) -> Column:
        return F.when(F.contains(line, F.lit("`")), F.regexp_replace(F.regexp_replace(line, RST_ROLE, "$1"), RST_QUOTED, "$1")).otherwise(line)

    return F.zip_with(
        rows, letters, lambda line, kind: F.when(kind != "u", F.concat(F.when(kind == "h", F.lit("\x01")).otherwise(""), plain(line)))
    )


def _rst_pieces(marked: Column) -> Column:
    pieces = F.split(F.array_join(F.filter(marked, lambda x: x.isNotNull()), "\n"), "\n?\x01")
    return F.filter(F.transform(pieces, X.strip), lambda x: x != "")


def _rst_found(pieces: Column, text: Column) -> Column:
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(X.strip(text)))


def rst_sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, text, page`` per section, as :func:`rst_section_texts` tells them.

    What a later step uses twice is a column of its own, because an expression used twice is worked
    out twice: the lines alone would be cut ten times over.
    """
    held = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("__text"))
    held = held.withColumn("__parts", F.split("__text", X.LINE_END))
    held = held.withColumn("__rows", X.without_last(F.col("__parts")))
    held = held.withColumn("__letters", _rst_letters(F.col("__rows"), _rst_below(F.col("__rows"))))
    held = held.withColumn("__pieces", _rst_pieces(_rst_marked(F.col("__rows"), F.col("__letters"))))
    return _explode_sections(held, _rst_found(F.col("__pieces"), F.col("__text")), id_col)


# HTML elements whose text is dropped (the first hold no markup), that end a line, and
# that open a section; and named characters.
HTML_RAW = ["script", "style", "noscript"]
HTML_HIDDEN = ["nav", "footer", "header", "aside"]
HTML_BLOCK = ["h1", "h2", "h3", "h4", "p", "li", "td", "th", "pre", "code", "dt", "dd", "blockquote"]
HTML_SECTION = ["h1", "h2"]
HTML_NAMED = {
    "&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©", "&reg;": "®",
    "&deg;": "°", "&plusmn;": "±", "&middot;": "·", "&times;": "×", "&ndash;": "–", "&mdash;": "—",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&bull;": "•", "&hellip;": "…", "&euro;": "€", "&amp;": "&",
}
HTML_TOKEN = r"</?[A-Za-z!?][^>]*>|[^<]+|<"


def html_characters(text: Column) -> Column:
    """Numbered and common named character references as characters."""

    def numbered(part: Column, at: Column) -> Column:
        decimal = F.regexp_extract(part, r"^([0-9]{1,7});", 1)
        hexed = F.regexp_extract(part, r"^[xX]([0-9A-Fa-f]{1,6});", 1)
        code = F.when(decimal != "", F.hex(decimal.cast("long"))).when(hexed != "", hexed)
        sign = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.when(at == 0, part).otherwise(
            F.coalesce(F.concat(sign, F.regexp_replace(part, r"^[^;]*;", "")), F.concat(F.lit("&#"), part))
        )

    out = F.when(
        F.contains(text, F.lit("&#")), F.array_join(F.transform(F.split(text, "&#"), numbered), "")
    ).otherwise(text)
    for name, sign in HTML_NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def html_sections(df: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """Visible text of pages, one row per level-1 or level-2 heading; a page without text has one empty row.

    Pages are cut into tags and texts; running sums along a page tell how deep inside hidden elements
    and in which section each piece lies. An end tag without its start counts for nothing: the sum is
    taken above its lowest point so far.
    """
    clean = F.regexp_replace(F.col(text_col), r"(?s)<!--.*?(?:-->|\z)", "")
    for name in HTML_RAW:
        clean = F.regexp_replace(clean, rf"(?is)<{name}\b.*?(?:</{name}\s*>|\z)", "")
    pages = df.filter(F.col(text_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("__page"), F.col(id_col).alias("__id"), clean.alias("__html")
    )
    tokens = pages.select(
        "__page", "__id", F.posexplode_outer(F.regexp_extract_all("__html", F.lit(HTML_TOKEN), 0)).alias("__at", "__token")
    )
    token = F.col("__token")
    tag = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    ends, alone = token.startswith("</"), token.endswith("/>")
    step = F.when(~tag.isin(HTML_HIDDEN) | alone, 0).when(ends, -1).otherwise(1)
    tokens = tokens.withColumns(
        {"__tag": tag, "__ends": ends, "__step": step, "__is_text": ~token.rlike(r"^</?[A-Za-z!?]")}
    )
    along = Window.partitionBy("__page").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("__tag").isin(HTML_SECTION) & ~F.col("__ends"), 1).otherwise(0)
    tokens = tokens.withColumns({"__sum": F.sum("__step").over(along), "__section": F.sum(opened).over(along)})
    depth = F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(along))
    words = X.strip(html_characters(token))
    piece = F.when(F.col("__is_text") & (depth == 0) & (words != ""), words).when(
        F.col("__ends") & F.col("__tag").isin(HTML_BLOCK), "\n"
    )
    parts = tokens.withColumn("__piece", piece).groupBy("__page", "__id", "__section").agg(
        F.array_sort(F.collect_list(F.when(F.col("__piece").isNotNull(), F.struct("__at", "__piece")))).alias("parts")
    )
    sections = parts.withColumn("text", X.strip(F.array_join(F.transform("parts", lambda x: x["__piece"]), " ")))
    whole = Window.partitionBy("__page")
    in_order = whole.orderBy("__section")
    kept = sections.withColumn("__none", F.max(F.col("text") != "").over(whole) == F.lit(False)).filter(
        (F.col("text") != "") | (F.col("__none") & (F.col("__section") == 0))
    )
    return kept.select(F.col("__id").alias(id_col), (F.row_number().over(in_order) - 1).cast("long").alias("page"), "text")


# --- chunks -------------------------------------------------------------------------------------


def chunk_sections(
    sections: DataFrame, id_col: str = "doc_id", size: int = 500, overlap: int = 50, shortest: int = 1
) -> DataFrame:
    """Chunks ``chunk_id, <id>, page, chunk_no, text`` of ``<id>, page, text`` sections.

    ``chunk_no`` counts the chunks kept within the section.
    """
    found = exploded(
        sections.withColumnRenamed("text", "__text"), [id_col, "page"], X.chunks(F.col("__text"), size, overlap, shortest), "text", "chunk_no"
    )
    return found.select(
        F.concat_ws("_", F.col(id_col).cast("string"), F.col("page").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"),
        id_col,
        "page",
        "chunk_no",
        "text",
    )


def sliding_window_texts(text: Column, size: int = 500, overlap: int = 50, shortest: int = 1) -> Column:
    """Windows over the space-collapsed text, ended at a sentence or word end past the middle, as an array.

    The text is cut once into pieces of ``size`` characters; a window lies in two neighbours, so no
    step reads the text from its start. Ends are worked out first, as a list of numbers; the windows
    are cut out at them afterwards. A rest shorter than ``overlap`` starts no window, as the one
    before holds it.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be below half the window")
    flat = F.regexp_replace(text, X.SPACE_CLASS + "+", " ")
    # Bound by lambdas, the collapsed text and its pieces are worked out once and not at every step.
    pieces = F.transform(
        F.array(flat), lambda t: F.struct(F.length(t).alias("total"), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), 0).alias("pieces"))
    )
    return F.get(F.transform(pieces, lambda p: _windows(p["pieces"], p["total"], size, overlap, shortest)), F.lit(0))


def _windows(pieces: Column, total: Column, size: int, overlap: int, shortest: int) -> Column:
    most = F.ceil(total / F.lit(size // 2 + 1 - overlap)).cast("int") + 1

    def cut(at: Column, length: Column) -> Column:
        piece = F.floor(at / size).cast("int")
        two = F.concat(F.coalesce(F.get(pieces, piece), F.lit("")), F.coalesce(F.get(pieces, piece + 1), F.lit("")))
        return F.substring(two, at - piece * size + 1, length)

    def after_last(window: Column, marks: str) -> Column:
        """Characters before the last of the marks; 0 without one."""
        return F.length(F.regexp_extract(window, rf"(?s)^(.*)[{marks}]", 1))

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use(value)`` with the value worked out once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def stop_in(window: Column, at: Column) -> Column:
        ends = F.struct(after_last(window, ".!?").alias("sentence"), after_last(window, " ").alias("word"))
        return bound(
            ends,
            lambda e: F.when(e["sentence"] > size // 2, at + e["sentence"] + 1).when(e["word"] > size // 2, at + e["word"]).otherwise(at + size),
        )

    def taken(acc: Column, stop: Column) -> Column:
        following = F.when(total - (stop - overlap) < overlap, total).otherwise(stop - overlap)
        full = F.size(acc["open"]) >= 256
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        opened = F.when(full, F.array(stop)).otherwise(F.concat(acc["open"], F.array(stop)))
        return F.struct(following.alias("at"), done.alias("done"), opened.alias("open"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        stop = F.when(at + size >= total, at + size).otherwise(bound(cut(at, F.lit(size)), lambda w: stop_in(w, at)))
        return F.when(at >= total, acc).otherwise(bound(stop, lambda s: taken(acc, s)))

    # Ends go to a short list and from there, many at once, to the long one, which is seldom copied.
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("done"), none.alias("open"))
    stops = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["open"]))))

    def texts(ends: Column) -> Column:
        """Each window but the first starts ``overlap`` before the end of the one before."""
        found = F.transform(ends, lambda e, i: X.strip(bound(F.when(i == 0, 0).otherwise(F.get(ends, i - 1) - overlap), lambda a: cut(a, e - a))))
        return F.filter(found, lambda x: F.length(x) >= shortest)

    return bound(stops, texts)


def sliding_chunks(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 500, overlap: int = 50, shortest: int = 1
) -> DataFrame:
    """``<id>, chunk_no, text``: windows of at least ``shortest`` characters, numbered in order."""
    return exploded(df, [id_col], sliding_window_texts(F.col(text_col), size, overlap, shortest), "text", "chunk_no")


# --- statistics ---------------------------------------------------------------------------------


def document_stats(chunks: DataFrame, documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sections, chunks and characters per document; documents without chunks count zero."""
    counted = chunks.groupBy(id_col).agg(
        (F.max("page") + 1).alias("n_pages"),
        F.count("*").alias("n_chunks"),
        F.sum(F.length("text")).alias("n_chunk_chars"),
    )
    return (
        documents.select(id_col, F.length("text").cast("long").alias("n_chars"))
        .join(counted, id_col, "left")
        .na.fill(0, ["n_pages", "n_chunks", "n_chunk_chars"])
    )


def store_status(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents and chunks in the store, from per-document counts."""
    return chunks.groupBy(id_col).count().agg(
        F.count("*").alias("n_docs"), F.sum("count").alias("n_chunks")
    )


def keywords(
    documents: DataFrame,
    chunks: DataFrame,
    id_col: str = "doc_id",
    name_col: str = "name",
    n_chunks: int | None = None,
    n_words: int = 8,
    n_keywords: int = 10,
) -> DataFrame:
    """Up to ten keywords per document: words of its name, then its most frequent longer words.

    Words are counted over all chunks, or the first ``n_chunks``; equal counts keep the
    order of first appearance.
    """
    used = chunks if n_chunks is None else _first_chunks(chunks, id_col, n_chunks)
    long_words = F.regexp_extract_all("text", F.lit(r"[A-Za-z]{4,}"), 0)
    found = exploded(used, [id_col, "page", "chunk_no"], long_words, "w", "pos")
    counted = found.groupBy(id_col, F.lower("w").alias("word")).agg(
        F.count("*").alias("n"), F.min(F.struct("page", "chunk_no", "pos")).alias("first")
    )
    best = (
        top_k(counted, [id_col], [F.desc("n"), F.asc("first")], n_words)
        .groupBy(id_col)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("top"))
    )
    named = documents.select(
        id_col,
        F.array_distinct(
            F.transform(F.regexp_extract_all(name_col, F.lit(r"[A-Za-z一-鿿]{2,}"), 0), F.lower)
        ).alias("named"),
    )
    both = F.array_distinct(F.concat("named", F.coalesce("top", F.lit([]).cast("array<string>"))))
    return named.join(best, id_col, "left").select(id_col, F.slice(both, 1, n_keywords).alias("keywords"))


def _first_chunks(chunks: DataFrame, id_col: str, n: int) -> DataFrame:
    return top_k(chunks, [id_col], [F.asc("page"), F.asc("chunk_no")], n, "__r").drop("__r")


# --- search in texts ----------------------------------------------------------------------------


def grep(
    df: DataFrame, pattern: str, path_col: str, text_col: str = "text", limit: int | None = None, width: int | None = None
) -> DataFrame:
    """Lines matching a case-insensitive pattern, with 1-based line numbers, in path order."""
    re.compile(pattern)
    found = (
        exploded(df, [path_col], X.lines(F.col(text_col)), "line_text", "at")
        .filter(F.col("line_text").rlike("(?iU)" + pattern))
        .select(
            path_col,
            (F.col("at") + 1).alias("line"),
            X.head(X.strip(F.col("line_text")), width).alias("content"),
        )
    )
    return found if limit is None else found.orderBy(path_col, "line").limit(limit)


def find(
    df: DataFrame,
    query: str,
    name_col: str,
    text_col: str = "text",
    limit: int | None = None,
    before: int = 60,
    after: int = 100,
    order: str | None = None,
) -> DataFrame:
    """Files whose name, else whose text, contains the query; text hits carry a snippet."""
    low = F.lit(query.lower())
    at = F.instr(F.lower(text_col), query.lower())
    start = F.greatest(at - before, F.lit(1))
    found = (
        df.withColumn(
            "match",
            F.when(F.contains(F.lower(name_col), low), "filename").when(at > 0, "content"),
        )
        .filter(F.col("match").isNotNull())
        .withColumn(
            "snippet",
            F.when(
                F.col("match") == "content",
                X.strip(F.substring(F.col(text_col), start, at + after - start)),
            ).otherwise(""),
        )
        .select(*dict.fromkeys([order or name_col, name_col]), "match", "snippet")
    )
    return found if limit is None else found.orderBy(order or name_col).limit(limit)


def read_text(df: DataFrame, id_col: str, text_col: str = "text", max_chars: int | None = None) -> DataFrame:
    """A text with its full length and whether ``max_chars`` cut it."""
    return df.select(
        id_col,
        X.head(F.col(text_col), max_chars).alias("content"),
        (F.lit(False) if max_chars is None else F.length(text_col) > max_chars).alias("truncated"),
        F.length(text_col).cast("long").alias("chars"),
    )


def paper_search(
    sections: DataFrame,
    query: str,
    paper_col: str = "doc_id",
    k: int | None = None,
    excerpt: int | None = None,
) -> DataFrame:
    """Sections holding at least half of the query's words; the ``k`` with most words, if given, cut to excerpts."""
    wanted = sorted(set(query.lower().split()))
    body = F.lower("content")
    hits = sum((F.contains(body, F.lit(w)).cast("int") for w in wanted), F.lit(0))
    passage = F.concat(
        F.lit("["), F.col(paper_col).cast("string"), F.lit(" / "), F.col("title"), F.lit("]\n"),
        X.head(F.col("content"), excerpt),
    )
    found = sections.select(hits.cast("long").alias("hits"), passage.alias("passage")).filter(
        F.col("hits") >= max(1, len(wanted) // 2)
    )
    return found if k is None else found.orderBy(F.desc("hits"), F.desc("passage")).limit(k)


def combined_context(
    papers: DataFrame, max_chars_per_paper: int | None = None, key_col: str = "doc_id", order: str = "doc_id"
) -> DataFrame:
    """One titled block of key content per paper, in order.

    ``papers`` has the key, ``title``, ``year``, ``abstract`` and ``sections``.
    """
    block = F.concat(
        F.lit("=== ["), F.col(key_col).cast("string"), F.lit("] "), F.col("title"), F.lit(" ("),
        F.coalesce("year", F.lit("")), F.lit(") ===\n"),
        X.key_content(F.col("abstract"), F.col("sections"), max_chars_per_paper),
    )
    return papers.select(key_col, block.alias("block"))


def papers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int | None = None) -> DataFrame:
    """Clean texts and cut them into a paper record: metadata, abstract, sections."""
    clean = df.withColumn("full_text", X.join_hyphenated(F.col(text_col))).withColumn(
        "sections", X.paper_sections(F.col("full_text"))
    )
    return clean.select(
        id_col,
        X.paper_metadata(F.col("full_text"), head_chars).alias("m"),
        X.abstract_of(F.col("sections"), F.col("full_text")).alias("abstract"),
        "sections",
        "full_text",
    ).select(id_col, "m.*", "abstract", "sections", "full_text")
