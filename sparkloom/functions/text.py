"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the sparse index leaves out.
STOPWORDS = (
    "a an the and or but nor so yet in on at to for of with by from into through during before after above below between out off over under up about against along among around as except per than toward within "
    "is are was were be been being have has had do does did will would could should may might shall can need must am it its this that these those i we you he she they me us him her them my our your his their "
    "what which who whom when where how why not no also if then just only very too again further once here there all any both each few more most other some such same either neither s t re"
).split()

#: Words that highlighting leaves out.
UNMARKED = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare used ought in on at to for of and or but not with this that it its as by from what how"
).split()

#: Everything but letters, digits, white space and the marks that carry meaning in units, decimals and compounds.
MARKS = r"[^\p{L}\p{N}_\s.\-°/%]"
#: Fixed value: how a list item starts.
BULLET = r"^(\s*[•·‣▸▶◦▪▫●○◆◇►]\s+|\s*[-*+]\s+|\s*\d{1,2}[.)]\s+|\s*[a-zA-Z][.)]\s+)"


def tokens(text: Column) -> Column:
    """Index tokens: lower case, marks to spaces, two characters or more, no stopwords."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), MARKS, " "), r"\s+", " "))
    return F.filter(F.split(plain, " "), lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda would compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def counted(words: Column) -> Column:
    """array<struct<tok, tf>> of an array of words: runs of the sorted array, so no row leaves its task."""

    def runs(w: Column) -> Column:
        places = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 1) | (F.element_at(w, F.greatest(i - 1, F.lit(1))) != F.element_at(w, i)))
        ends = lambda s: F.slice(F.concat(s, F.array(F.size(w) + 1)), 2, F.size(s))
        return let(starts, lambda s: F.zip_with(s, ends(s), lambda a, b: F.struct(F.element_at(w, a).alias("tok"), (b - a).alias("tf"))))

    return F.coalesce(let(F.sort_array(words), runs), F.array().cast("array<struct<tok: string, tf: int>>"))


def content_hash(source: Column, page: Column, content: Column) -> Column:
    """The content key that joins chunks with vectors; a null page reads None."""
    return F.md5(F.concat(source, F.lit("|"), F.coalesce(page.cast("string"), F.lit("None")), F.lit("|"), F.substring(content, 1, 80)).cast("binary"))


def parent_id(source: Column, page: Column, section: Column, index: Column) -> Column:
    key = F.concat(source, F.lit("|p"), F.coalesce(page.cast("string"), F.lit("None")), F.lit("|"), section, F.lit("|"), index.cast("string"))
    return F.concat(F.lit("par_"), F.substring(F.md5(key.cast("binary")), 1, 12))


def is_bullet(content: Column) -> Column:
    """Whether any line starts like a list item."""
    return F.exists(F.split(content, "\n"), lambda line: line.rlike(BULLET))


def heading_level(size: Column, body: Column) -> Column:
    return F.when(size >= 1.8 * body, 1).when(size >= 1.4 * body, 2).otherwise(3)


def block_type(size: Column, body: Column, content: Column) -> Column:
    """Heading by font size and length, else bullet, else text."""
    return F.when((size >= 1.15 * body) & (F.length(content) < 200), "heading").when(is_bullet(content), "bullet").otherwise("text")


def or_else(first: Column, second: Column) -> Column:
    """``first`` unless it is null or empty."""
    return F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(second)


def highlight(text: Column, query: Column) -> Column:
    """Marks the query's longer words in the text, whatever their case."""
    skip = F.array(*[F.lit(w) for w in UNMARKED])
    words = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(skip, w))
    safe = F.transform(words, lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    pattern = F.concat(F.lit("(?iu)("), F.array_join(safe, "|"), F.lit(")"))
    return F.when(F.size(words) == 0, text).otherwise(F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>")))


def preview(text: Column) -> Column:
    """Long cards show their first three lines."""
    lines = F.split(text, "\n")
    return F.when((F.size(lines) > 3) | (F.length(text) > 300), F.array_join(F.slice(lines, 1, 3), "\n")).otherwise(text)


def relevance_band(score: Column) -> Column:
    percent = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * 100
    return F.when(percent > 65, "high").when(percent > 35, "medium").otherwise("low")


def context_block(source: Column, page: Column, section_path: Column, heading: Column, content: Column) -> Column:
    """A chunk as the model reads it: a header line, then the text without white space around it."""
    section = or_else(section_path, heading)
    header = F.concat_ws(" | ", F.concat(F.lit("Source: "), source), F.concat(F.lit("Page: "), page.cast("string")), F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section: "), section)))
    return F.concat(F.lit("["), header, F.lit("]\n"), stripped(content))


#: White space of every kind, in Java's regular expressions: what text is stripped of.
WHITE = r"[\s\x1C-\x1F\x85\p{Z}]"


def stripped(text: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def filled(text: Column) -> Column:
    """Whether there is anything but white space; false for null."""
    return F.coalesce(stripped(text), F.lit("")) != ""


def filename_of(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def breadcrumb(path: Column) -> Column:
    return F.filter(F.split(path, r"\s*[>/]\s*"), lambda x: x != "")


#: Fixed value: what queries, and only they, are given in front for encoders of the asymmetric kind.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def query_text(question: Column, prefix: str = QUERY_PREFIX) -> Column:
    return F.concat(F.lit(prefix), stripped(question))


def bbox_json(bbox: Column) -> Column:
    """A box as JSON text, empty for none."""
    return F.when(bbox.isNull(), "").otherwise(F.to_json(bbox))


def bbox_of(text: Column) -> Column:
    """The box in a JSON text; null where it is empty or not one."""
    return F.try_element_at(F.array(F.from_json(F.concat(F.lit('{"b":'), F.when(text != "", text), F.lit("}")), "b array<double>")), F.lit(1))["b"]


def canvas_box(bbox: Column, page_height: Column, scale: Column) -> Column:
    """struct(x, y, width, height) on a canvas of a box in points; both count y from the top of the page, so that nothing is turned over.

    ``page_height`` bounds the box: what lies below the page is cut off.
    """
    x0, y0, x1, y1 = (bbox[k] for k in range(4))
    y1 = F.least(y1, F.coalesce(page_height, y1))
    return F.struct((x0 * scale).alias("x"), (y0 * scale).alias("y"), ((x1 - x0) * scale).alias("width"), ((y1 - y0) * scale).alias("height"))


def page_sample(page_text: Column) -> Column:
    """The start of a page, on one line, as an image's label quotes it."""
    return stripped(F.replace(F.substring(stripped(page_text), 1, 300), F.lit("\n"), F.lit(" ")))


def image_label(page: Column, figure: Column, page_text: Column, source: Column) -> Column:
    """The text that stands for an image: its page and figure number, and the start of the page's text or the file's name."""
    head = F.concat(F.lit("[IMAGE — Page "), page.cast("string"), F.lit(", Figure "), figure.cast("string"), F.lit("] "))
    near = page_sample(F.coalesce(page_text, F.lit("")))
    return F.concat(head, F.when(near != "", F.concat(F.lit("Figure on this page. Page context: "), near)).otherwise(F.concat(F.lit("Visual figure or diagram from "), source)))


def image_url(path: Column) -> Column:
    return F.concat(F.lit("/images/"), F.element_at(F.split(path, "/"), -1))


def public_url(base: str, bucket: str, filename: Column) -> Column:
    return F.concat(F.lit(f"{base}/storage/v1/object/public/{bucket}/"), filename)


def file_icon(filename: Column) -> Column:
    """The mark of each file type."""
    name = F.lower(filename)
    return F.when(name.endswith(".pdf"), "📄").when(name.endswith(".csv"), "📊").when(name.endswith(".xlsx"), "📗").otherwise("📝")


def chunk_icon(kind: Column) -> Column:
    """The mark of each chunk type."""
    return F.when(kind == "image", "🖼").when(kind == "table", "⊞").otherwise("◈")


def short_section(section: Column) -> Column:
    return F.when(F.length(section) > 22, F.concat(F.substring(section, 1, 22), F.lit("…"))).otherwise(section)
