"""Web pages as columns and rows: metadata and links from the text of tags, headings and text from rows of tokens.

A page is cut into tokens (tags and the text between them). What belongs to
what follows from windows over a page's tokens: an element ends at the closing
tag of its own depth, or, where it has none, with the element around it; nothing
is repaired. Comments, scripts and styles are no tokens.

Defined results: a null page has no metadata, no links and null text; an empty
one has empty text.
"""

from __future__ import annotations

import html as entities

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import constants as K
from .shared import written

META = ("description", "keywords", "author", "og_title", "og_description", "og_image")
#: Links of a page that are kept, and characters of their text.
MOST_LINKS, LINK_TEXT = 100, 100

#: What never ends goes on to the end of the page.
_DROPPED = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_INSIDE = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
#: "<" before anything but a name or a mark is text; it goes through the cutting as a private character.
_BARE, _HELD = r"<(?![a-zA-Z/!?])", "\ue000"
_TOKEN = rf"(?is)</?[a-z]{_INSIDE}>|<[!?][^>]*>|[^<]+|<"
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else entities.unescape(t))


def unescaped(text: Column) -> Column:
    """Character references replaced; only texts with an ampersand go through Python."""
    return F.coalesce(_unescaped(F.when(F.contains(text, F.lit("&")), text)), text)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value as it is written in a tag, '' if it has none."""
    value = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def metadata(pages: DataFrame) -> DataFrame:
    """page_id, title, the host of its address and what its meta tags say: the first of each name. No shuffle."""
    body = F.regexp_replace("html", _DROPPED, "")
    title = F.when(body.rlike(r"(?i)<title[\s>]"), F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)(?:</title|$)", 1))
    rows = pages.select("page_id", "url", title.alias("title"), F.regexp_extract_all(body, F.lit(rf"(?is)<meta\b{_INSIDE}>"), F.lit(0)).alias("metas"))
    name = lambda m: F.regexp_replace(F.coalesce(F.nullif(attribute(m, "name"), F.lit("")), attribute(m, "property")), ":", "_")
    first = lambda n: F.get(F.filter("metas", lambda m: (name(m) == n) & m.rlike(r"(?i)\scontent\s*=")), F.lit(0))
    values = [unescaped(attribute(first(n), "content")).alias(n) for n in META]
    return rows.select("page_id", stripped(unescaped(F.col("title"))).alias("title"), F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1).alias("domain"), *values)


def links(pages: DataFrame) -> DataFrame:
    """page_id, position (from 0), href, text and is_internal of a page's links: not empty and not to a place of the page itself. No shuffle."""
    anchors = F.regexp_extract_all(F.regexp_replace("html", _DROPPED, ""), F.lit(rf"(?is)<a(?=[\s>]){_INSIDE}>.*?(?=</a\s*>|<a[\s>]|$)"), F.lit(0))
    tag = lambda a: F.regexp_extract(a, rf"(?is)^<a{_INSIDE}>", 0)
    asked = F.filter(anchors, lambda a: ~attribute(tag(a), "href").rlike("^(#|$)"))
    rows = pages.select("page_id", "url", F.posexplode(F.slice(asked, 1, MOST_LINKS)).alias("position", "a"))
    text = unescaped(F.regexp_replace("a", rf"(?is)</?[a-z!]{_INSIDE}>", ""))
    rows = rows.select("page_id", "url", "position", unescaped(attribute(tag(F.col("a")), "href")).alias("href"), F.substring(stripped(text), 1, LINK_TEXT).alias("text"))
    host = lambda c: F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return rows.select("page_id", "position", "href", "text", ((host("href") == "") | (host("href") == host("url"))).alias("is_internal"))


def _matches(selector: str) -> Column:
    """Whether a tag (columns tag, id, classes, role) is one that a selector names."""
    if selector[0] == "[":
        return F.col("role") == selector[1:-1].split("=")[1]
    mark = next((c for c in ".#" if c in selector), "")
    tag, _, name = selector.partition(mark) if mark else (selector, "", "")
    found = F.lit(True) if not tag else F.col("tag") == tag
    return found & (F.array_contains("classes", name) if mark == "." else F.col("id") == name if mark else F.lit(True))


def _any(selectors: tuple[str, ...]) -> Column:
    """_matches for several: sets of tags, ids, classes and roles."""
    sets: dict[str, list[str]] = {"tag": [], "id": [], "role": [], "class": []}
    rest = []
    for s in selectors:
        kind = "role" if s[0] == "[" else "class" if s[0] == "." else "id" if s[0] == "#" else "tag" if s.isalnum() else ""
        if kind:
            sets[kind].append(s[1:-1].split("=")[1] if kind == "role" else s.lstrip(".#"))
        else:
            rest.append(s)
    out = F.col("tag").isin(sets["tag"]) | F.col("id").isin(sets["id"]) | F.col("role").isin(sets["role"]) | F.arrays_overlap("classes", F.array(*(F.lit(c) for c in sets["class"])))
    for s in rest:
        out = out | _matches(s)
    return out


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, pos, token, tag, kind (open, close, text), the attributes that selectors ask for, and end: where an element's last token is (a number beyond the page if it never ends)."""
    found = F.regexp_extract_all(F.regexp_replace(F.regexp_replace("html", _DROPPED, ""), _BARE, _HELD), F.lit(_TOKEN), F.lit(0))
    # posexplode_outer, as for posexplode the planner would make the tokens twice.
    rows = pages.select("page_id", F.posexplode_outer(found).alias("pos", "token")).where("token IS NOT NULL").withColumn("token", F.translate("token", _HELD, "<"))
    # Dealt by page once: all windows below are inside a page and need no other exchange.
    rows = rows.withColumn("tag", F.lower(F.regexp_extract("token", r"^</?([A-Za-z][^\s/>]*)", 1)))
    # (By number, as the planner would put a small table into one task.)
    rows = rows.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")
    kind = F.when(F.col("token").rlike("^<[!?]"), "none").when(F.col("tag") == "", "text").when(F.col("token").startswith("</"), "close").otherwise("open")
    rows = rows.withColumn("kind", kind).where("kind <> 'none'")
    single = F.col("tag").isin(*_VOID) | F.col("token").endswith("/>")
    step = F.when((F.col("kind") == "open") & ~single, 1).when(F.col("kind") == "close", -1).otherwise(0)
    opened = F.col("kind") == "open"
    rows = rows.withColumn("step", step)
    for name in ("id", "class", "role"):
        rows = rows.withColumn(name, F.when(opened, attribute(F.col("token"), name)).otherwise(""))
    rows = rows.withColumn("classes", F.split(F.trim(F.regexp_replace("class", r"\s+", " ")), " ")).drop("class")

    # Depth of each tag among those of its name; a closing tag with nothing to close takes no depth.
    page = Window.partitionBy("page_id")
    named = Window.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("step").over(named))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("run").over(named)))
    rows = rows.withColumn("stray", (F.col("step") == -1) & (F.col("run") == F.col("low")) & (F.col("run") < F.coalesce(F.lag("low").over(Window.partitionBy("page_id", "tag").orderBy("pos")), F.lit(0))))
    level = F.col("run") - F.col("low") + F.when(F.col("step") == -1, 1).otherwise(0)
    rows = rows.withColumn("level", F.when((F.col("step") == 0) | F.col("stray"), -1).otherwise(level))
    same = Window.partitionBy("page_id", "tag", "level").orderBy("pos")
    rows = rows.withColumn("own", F.when((F.col("step") == 1) & (F.lead("step").over(same) == -1), F.lead("pos").over(same)))
    rows = rows.withColumn("closes", (F.col("step") == -1) & (F.col("level") > 0))
    # Elements without an end of their own end with the element around them: the next closing tag at the depth that they stand at.
    ordered = page.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("own").isNotNull(), 1).when(F.col("closes"), -1).otherwise(0)).over(ordered)
    rows = rows.withColumn("depth", depth + F.when(F.col("closes"), 1).otherwise(0))
    around = Window.partitionBy("page_id", "depth").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)  # backwards, as frames to the end of a partition are made anew for each row
    outer = F.coalesce(F.min(F.when(F.col("closes"), F.col("pos"))).over(around), F.lit(1 << 30))
    end = F.when(F.col("step") == 1, F.coalesce("own", outer)).when(opened, F.col("pos"))
    return rows.select("page_id", "pos", "token", "tag", "kind", "id", "classes", "role", end.alias("end"))


def _content(pages: DataFrame) -> DataFrame:
    """tokens without what is no content, with math as its TeX, and `text` of text tokens."""
    rows = tokens(pages)
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("gone", F.max(F.when((F.col("kind") == "open") & _any(K.PRUNED), F.col("end"))).over(before))
    rows = rows.where("gone IS NULL OR gone < pos").drop("gone").withColumn("text", F.when(F.col("kind") == "text", unescaped(F.col("token"))))
    # Tokens inside a math element share its place; its TeX is the text of its first annotation, else its alttext.
    last = lambda tag: F.last(F.when((F.col("kind") == "open") & (F.col("tag") == tag), F.struct("pos", "end")), ignorenulls=True).over(before)
    rows = rows.withColumn("math", last("math")).withColumn("note", last("annotation"))
    rows = rows.withColumn("math", F.when(F.col("math.end") >= F.col("pos"), F.col("math.pos")))
    inside = Window.partitionBy("page_id", "math")
    rows = rows.withColumn("note", F.when(F.col("math").isNotNull() & (F.col("note.end") > F.col("pos")) & (F.col("note.pos") > F.col("math")), F.col("note.pos")))
    rows = rows.withColumn("first", F.when(F.col("math").isNotNull(), F.min("note").over(inside)))
    noted = F.array_sort(F.collect_list(F.when((F.col("note") == F.col("first")) & (F.col("kind") == "text"), F.struct("pos", "text"))).over(inside))
    noted = F.when(F.col("math").isNotNull(), F.array_join(F.transform(noted, lambda x: x["text"]), ""))
    alt = F.when((F.col("pos") == F.col("math")), attribute(F.col("token"), "alttext"))
    tex = F.when(F.col("first").isNotNull(), noted).otherwise(F.max(alt).over(inside))
    tex = F.regexp_replace(flat(tex), r"^\{\\displaystyle (.*)\}$", "$1")
    rows = rows.withColumn("tex", F.when(F.col("math").isNotNull(), F.trim(tex)))
    kept = F.col("tex").isNull() | (F.col("tex") == "") | (F.col("pos") == F.col("math"))
    new = F.when(F.col("tex") != "", F.concat(F.lit(" "), "tex", F.lit(" ")))
    return rows.where(kept).withColumn("text", F.coalesce(new, F.col("text"))).drop("math", "note", "first", "tex")


def headings(pages: DataFrame) -> DataFrame:
    """page_id, pos, level, tag and text of a page's headings that aren't blank."""
    rows = _content(pages)
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when((F.col("kind") == "open") & F.col("tag").rlike("^h[1-6]$"), F.struct("pos", "end", "tag")), ignorenulls=True).over(before)
    rows = rows.withColumn("head", head).where("head.end > pos AND text IS NOT NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    found = rows.groupBy("page_id", "head").agg(flat(joined).alias("text")).where("text <> ''")
    return found.select("page_id", F.col("head.pos").alias("pos"), F.substring("head.tag", 2, 1).cast("int").alias("level"), F.col("head.tag").alias("tag"), "text")


def texts(pages: DataFrame) -> DataFrame:
    """page_id and text of a page's content, before cleaning: leaf blocks line by line, table rows with their cells, headings marked; all text if blocks hold too little of it."""
    rows = _content(pages)
    # The container: of the first selector whose first element has text, else the body, else the page.
    opened = F.col("kind") == "open"
    names = [f"c{i}" for i in range(len(K.CONTAINERS) + 1)]
    page = Window.partitionBy("page_id")
    for name, selector in zip(names, (*K.CONTAINERS, "body"), strict=True):
        rows = rows.withColumn(name, F.min(F.when(opened & _matches(selector), F.struct("pos", "end"))).over(page))
    inside = lambda c: (F.col("pos") > F.col(f"{c}.pos")) & (F.col("pos") < F.col(f"{c}.end"))
    has_text = rows.withColumn("has", flat(F.col("text")) != "")
    filled = lambda c: F.max(F.when(F.col("has") & inside(c), 1)).over(page)
    chosen = F.coalesce(*(F.when(filled(c) == 1, F.col(c)) for c in names[:-1]), F.col(names[-1]), F.struct(F.lit(-1).alias("pos"), F.lit(1 << 30).alias("end")))
    rows = has_text.withColumn("c", chosen).drop(*names, "has", "id", "classes", "role", "token").where(inside("c"))

    before = page.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_block = opened & F.col("tag").isin(*K.BLOCKS)
    rows = rows.withColumn("next", F.min(F.when(is_block, F.col("pos"))).over(page.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)))
    leaf = F.coalesce(F.col("next") > F.col("end"), F.lit(True))
    rows = rows.withColumn("block", F.last(F.when(is_block, F.struct("pos", "end", "tag", leaf.alias("leaf"))), ignorenulls=True).over(before))
    cell = F.last(F.when(opened & F.col("tag").isin("th", "td"), F.struct("pos", "end")), ignorenulls=True).over(before)
    rows = rows.withColumn("cell", cell).where("text IS NOT NULL").select("page_id", "pos", "text", "block", "cell")
    rows = written(rows, "page-texts")  # summed up twice below, by blocks and as a whole
    in_block = (F.col("block.end") > F.col("pos")) & F.col("block.leaf")
    in_cell = F.when(F.col("block.tag") == "tr", F.when((F.col("cell.pos") > F.col("block.pos")) & (F.col("cell.end") > F.col("pos")), F.col("cell.pos"))).otherwise(F.lit(-1))
    joined = lambda c, mark: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("x")))), lambda v: v["x"]), mark)
    cells = rows.where(in_block).withColumn("at", in_cell).where("at IS NOT NULL").groupBy("page_id", "block", "at").agg(flat(joined("text", "")).alias("text")).where("text <> ''")
    lines = cells.groupBy("page_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda v: v["text"]), " | ").alias("text"))
    marked = F.when(F.col("block.tag").rlike("^h[1-6]$"), F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.substring("block.tag", 2, 1).cast("int")), F.lit(" "), "text", F.lit("\n"))).otherwise(F.col("text"))
    blocks = lines.select("page_id", F.col("block.pos").alias("pos"), marked.alias("line")).groupBy("page_id").agg(joined("line", "\n").alias("blocks"))
    whole = rows.groupBy("page_id").agg(flat(joined("text", "")).alias("whole"), F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda v: flat(v["text"])), lambda t: t != ""), "\n").alias("pieces"))
    found = whole.join(blocks, "page_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit("")))
    covered = F.length(flat(F.col("blocks"))) >= K.COVERAGE * F.length("whole")
    text = found.select("page_id", F.when(covered, F.col("blocks")).otherwise(F.col("pieces")).alias("text"))
    return pages.select("page_id", F.col("html").isNotNull().alias("some")).join(text, "page_id", "left").select("page_id", F.when(F.col("some"), F.coalesce("text", F.lit(""))).alias("text"))
