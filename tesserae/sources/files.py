"""Files as a source: scans, path patterns, languages, URL lists, HTML pages, JSON lines and the chunk store."""

from __future__ import annotations

import fnmatch
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.text import normalised_text

# Languages by suffix.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin",
    ".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".sh": "shell",
}


def language_of(path: Column) -> Column:
    """Language by the lower-case suffix; ``text`` without a known one."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    pairs = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, suffix), F.lit("text"))


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Shell patterns in which ``*`` crosses slashes, so ``**/*.py`` needs a slash; no patterns match nothing."""
    regexes = [fnmatch.translate(p).replace("\\Z", "$").replace("\\z", "$") for p in patterns]
    return F.regexp_like(path, F.lit("|".join(regexes))) if regexes else F.lit(False)


def line_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def scan(spark: SparkSession, root: str, include: list[str], exclude: list[str], repo_id: str, repo_commit: str) -> DataFrame:
    """Files below ``root`` by patterns, decoded as UTF-8 with replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:", ""), f"^/*{re.escape(base.lstrip('/'))}", "")
    files = raw.select(path.alias("rel_path"), F.col("path").alias("abs_path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    kept = files.where(matches_any(F.col("rel_path"), include) & ~matches_any(F.col("rel_path"), exclude))
    return kept.select(F.lit(repo_id).alias("repo_id"), F.lit(repo_commit).alias("repo_commit"), "rel_path", "abs_path", language_of(F.col("rel_path")).alias("language"), "content", "size_bytes", line_count(F.col("content")).alias("line_count"), "modified_at")


def manual_commit(modified_at: Column) -> Column:
    """Aggregate: the commit id of a corpus without version control, from its latest change in milliseconds."""
    return F.concat(F.lit("manual-"), F.lpad(F.max(F.unix_millis(modified_at)).cast("string"), 33, "0"))


def parsed_urls(lines: DataFrame, line: str = "line") -> DataFrame:
    """``url, title`` of a URL list's lines: a markdown link, ``title | url`` or a bare URL; blank lines and comments are skipped, others raise."""
    text = F.trim(F.col(line))
    kept = lines.where((text != "") & ~F.startswith(text, F.lit("#")))
    link, bar = r"^\[([^\]]*)\]\((https?://[^)\s]+)\)$", r"^(.*?)\s*\|\s*(https?://\S+)$"
    url = F.coalesce(*[F.nullif(F.regexp_extract(text, p, g), F.lit("")) for p, g in ((link, 2), (bar, 2), (r"^(https?://\S+)$", 1))])
    title = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (link, bar)])
    return kept.select(F.coalesce(url, F.raise_error(F.concat(F.lit("no URL in: "), text))).alias("url"), title.alias("title"))


def kind_of(content_type: Column, url: Column) -> Column:
    """html, pdf, markdown or text, by content type, else by the URL's suffix."""
    kind, path = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return (
        F.when(F.contains(kind, F.lit("html")), "html").when(F.contains(kind, F.lit("pdf")), "pdf").when(F.contains(kind, F.lit("markdown")), "markdown")
        .when(F.endswith(path, F.lit(".pdf")), "pdf").when(F.regexp_like(path, F.lit(r"\.(md|markdown)$")), "markdown").when(F.endswith(path, F.lit(".txt")), "text").when(kind.startswith("text/plain"), "text").otherwise("html")
    )


# What a tag's start and end put into the markdown, and tags whose content is left out.
BLOCKS, BREAKS, HEADINGS, HIDDEN = ("p", "div", "section", "article", "main"), ("br", "hr"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("script", "style", "noscript")
OPENED = {t: "\n\n" for t in BLOCKS} | {t: "\n" for t in BREAKS} | {t: "\n\n" + "#" * n + " " for n, t in enumerate(HEADINGS, 1)} | {"li": "\n- "}
CLOSED = {t: "\n" for t in (*BLOCKS, "li")} | {t: "\n\n" for t in HEADINGS}


class _Page(HTMLParser):
    """Pieces of a page's title and of its markdown."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.body: list[str] = []
        self.title: list[str] = []
        self.hidden = 0
        self.into = self.body

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif not self.hidden and tag == "title":
            self.into = self.title
        elif not self.hidden:
            self.body.append(OPENED.get(tag, ""))

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            self.hidden -= tag in HIDDEN
        elif tag == "title":
            self.into = self.body
        else:
            self.body.append(CLOSED.get(tag, ""))

    def handle_data(self, data: str) -> None:
        if not self.hidden and (self.into is self.title or data.strip()):
            self.into.append(data if self.into is self.title else data.strip() + " ")


def page_markdown(page: str | None, fallback: str = "Untitled") -> tuple[str | None, str | None]:
    """Title and markdown body of an HTML page, both normalised; a page without a body has its title for one. Null gives nulls."""
    if page is None:
        return None, None
    parser = _Page()
    parser.feed(page)
    parser.close()
    title = (normalised_text(" ".join(parser.title)) or "").strip() or fallback
    body = normalised_text("".join(parser.body)) or ""
    return title, body if body.strip() else title + "\n"


def html_markdown(pages: Column) -> Column:
    """``page_markdown`` on a column: a struct of ``title`` and ``body``."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_markdown(t) for t in texts], columns=["title", "body"])

    return F.pandas_udf(run, "title string, body string")(pages)


def upserted(rows: DataFrame, key: list[str], version: list[Column]) -> DataFrame:
    """The last version of each key, as an upsert leaves it."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*version))).where("_n = 1").drop("_n")


def many(ids: DataFrame, rows: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of the wanted ids in the order asked for; missing ones are left out."""
    return ids.join(rows, key).orderBy(position)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunk table, partitioned as every read of it filters."""
    chunks.write.mode("overwrite").partitionBy("repo_id", "repo_commit").parquet(path)


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with a schema; bad lines raise if ``strict`` and else go."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
