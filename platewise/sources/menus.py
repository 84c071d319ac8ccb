"""Menu items out of web pages: JSON-LD blocks, page markup, annotations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.categories import likely_food

# Tags and bounds of menus.
DIET_MARKS = {"vegan": r"\(vg\)|\bvegan\b|🌱", "vegetarian": r"\(v\)|\bvegetarian\b|🥬", "gluten_free": r"\(gf\)|gluten[ -]?free", "dairy_free": r"\(df\)|dairy[ -]?free", "nut_free": r"\(nf\)|nut[ -]?free", "halal": r"\bhalal\b", "kosher": r"\bkosher\b", "spicy": r"🌶|\bspicy\b"}
BOUNDS = {"calories": (20, 3000), "protein": (0, 200), "carbs": (0, 400), "fat": (0, 200)}
ENTRY_TAGS = ("li", "tr", "dt")
ENTRY_CLASS = "menu-item|dish|food-item"
IMPLIED_ENDS = {"li": ("li", "ul", "ol"), "tr": ("tr", "table"), "dt": ("dt", "dl"), "dd": ("dt", "dl")}
ITEM = "struct<name:string,description:string,price:string,category:string>"
OFFER = "offers:struct<price:string>"
LD_ITEM = f"struct<name:string,description:string,{OFFER}>"
LD_SECTION = f"struct<name:string,hasMenuItem:array<{LD_ITEM}>>"
LD = f"struct<`@type`:string,name:string,hasMenu:struct<hasMenuSection:array<{LD_SECTION}>,hasMenuItem:array<{LD_ITEM}>>>"


def menu_from_jsonld(pages: DataFrame) -> DataFrame:
    """Items of the Restaurant blocks of a page: sections' items and items without a section."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    ld = pages.select("page_id", "url", F.explode(blocks).alias("j")).withColumn("r", F.from_json("j", LD)).where("r.hasMenu is not null")
    none = F.array().cast(f"array<{LD_ITEM}>")
    loose = F.struct(F.lit(None).cast("string").alias("name"), F.coalesce("r.hasMenu.hasMenuItem", none).alias("hasMenuItem"))
    sections = F.concat(F.coalesce("r.hasMenu.hasMenuSection", F.array().cast(f"array<{LD_SECTION}>")), F.array(loose))
    s = ld.select("page_id", "url", F.explode(sections).alias("s")).select("page_id", "url", F.col("s.name").alias("category"), F.explode("s.hasMenuItem").alias("i"))
    price = F.col("i.offers.price")
    price = F.when(price.isNotNull() & ~price.startswith("$"), F.concat(F.lit("$"), price)).otherwise(price)
    out = s.select("page_id", "url", F.trim("i.name").alias("name"), F.col("i.description").alias("description"), price.alias("price"), "category", ingredients_from_description(F.col("i.description")).alias("menu_ingredients"))
    return out.where("name is not null and name <> ''")


def ingredients_from_description(c: Column) -> Column:
    """Ingredient text of a description: after contains/with words, or a comma list of three or more."""
    d = F.trim(c)
    said = F.regexp_extract(d, r"(?i)(?:contains|ingredients|made with|served with|topped with)\s*:?\s*(.+)$", 1)
    return F.when(said != "", F.regexp_replace(said, r"\.$", "")).when((F.size(F.split(d, ",")) >= 3) & (F.length(d) <= 300), F.regexp_replace(d, r"\.$", ""))


class _Menu(HTMLParser):
    """Item containers by class, else headings followed by list items."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.listed, self.heading, self.stack = [], [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "meta", "link", "input", "wbr"):
            return
        self.stack.append([tag, (dict(attrs).get("class") or "").lower(), []])

    def handle_data(self, data):
        for level in self.stack:
            level[2].append(data)

    def handle_endtag(self, tag):
        if not any(x[0] == tag for x in self.stack):
            return
        while self.stack:
            level = self.stack.pop()
            text = " ".join(" ".join(level[2]).split())
            if re.search(r"\b(?:menu|dish)-?item\b", level[1]):
                f = dict(level[3:])
                name = f.get("name") or re.split(r"\s*\$", text)[0]
                m = re.search(r"\$\s*\d+(?:\.\d{2})?", f.get("price") or text)
                self.items.append((name.strip(), f.get("description"), m[0].replace(" ", "") if m else None, self.heading))
            else:
                self._closed(level[0], level[1], text)
            if level[0] == tag:
                break

    def _closed(self, tag, cls, text):
        inside = next((x for x in reversed(self.stack) if re.search(r"\b(?:menu|dish)-?item\b", x[1])), None)
        if inside is not None:
            field = "price" if "price" in cls else "description" if "desc" in cls else "name" if "name" in cls or "title" in cls or tag in ("h3", "h4", "h5") else None
            if field:
                inside.append((field, text))
        if tag in ("h1", "h2", "h3", "h4") and inside is None:
            self.heading = text
        elif tag == "li" and self.heading:
            self.listed.append((text, self.heading))


def items_of_page(html: str) -> list[tuple]:
    p = _Menu()
    p.feed(html or "")
    p.close()
    if p.items:
        return [i for i in p.items if i[0]]
    out = []
    for text, heading in p.listed:
        m = re.search(r"\$\s*\d+(?:\.\d{2})?", text)
        name, _, rest = re.sub(r"\s*\$\s*\d+(?:\.\d{2})?\s*", " ", text).strip().partition(" - ")
        if name:
            out.append((name.strip(), rest.strip() or None, m[0].replace(" ", "") if m else None, heading))
    return out


def menu_from_html(pages: DataFrame) -> DataFrame:
    """Items of a page's markup that look like food, with the nearest heading as category."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, u, *item) for i, u, h in zip(pdf.page_id, pdf.url, pdf.html) for item in items_of_page(h)]
            yield pd.DataFrame(rows, columns=["page_id", "url", "name", "description", "price", "category"])

    out = pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, url string, name string, description string, price string, category string")
    return out.where(likely_food("name", "description")).withColumn("menu_ingredients", ingredients_from_description(F.col("description")))


def raw_annotations(name: Column, description: Column) -> Column:
    """Diet tags and footnote markers of a raw name and description."""
    both = F.lower(F.concat_ws(" ", name, description))
    tags = F.filter(F.array(*[F.when(both.rlike(p), F.lit(t)) for t, p in DIET_MARKS.items()]), lambda x: x.isNotNull())
    return F.struct(tags.alias("tags"), F.array_distinct(F.regexp_extract_all(name, F.lit(r"[*†‡]+"), F.lit(0))).alias("marks"))


def menu_annotations(pages: DataFrame) -> DataFrame:
    """Legend of a page's marks, and nutrition amounts within sane bounds, from its text."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", " ")
    legend = F.regexp_extract_all("t", F.lit(r"([*†‡]+)\s*=?\s*(?:contains|may contain)\s+[a-z ,]+"), F.lit(0))
    out = pages.select("page_id", text.alias("t"))
    marks = F.transform(legend, lambda x: F.struct(F.regexp_extract(x, r"^([*†‡]+)", 1).alias("mark"), F.trim(F.regexp_extract(x, r"contain\w*\s+(.+)$", 1)).alias("meaning")))
    unit = {"calories": r"(\d{1,4})\s*(?:kcal|calories|cal)\b", "protein": r"(\d{1,3})\s*g\s+protein", "carbs": r"(\d{1,3})\s*g\s+carb", "fat": r"(\d{1,3})\s*g\s+fat"}

    def bounded(c, pattern):
        v = F.nullif(F.regexp_extract(F.lower("t"), pattern, 1), F.lit("")).cast("int")
        return F.when(v.between(*BOUNDS[c]), v).alias(c)

    return out.select("page_id", F.array_distinct(marks).alias("legend"), *[bounded(c, p) for c, p in unit.items()])


class _Entries(HTMLParser):
    """List entries, table rows and elements of a menu-item class, each with the text that is its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.stack, self.text = [], [], []

    def _entry(self):
        return next((x[1] for x in reversed(self.stack) if x[1] is not None), None)

    def handle_starttag(self, tag, attrs):
        self.text.append(" ")
        if tag in ("br", "img", "hr", "meta", "link", "input", "wbr"):
            return
        cls = (dict(attrs).get("class") or "").lower()
        if tag in IMPLIED_ENDS:  # the entry before ends where the next one begins
            around = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] in IMPLIED_ENDS[tag]), None)
            if around is not None and self.stack[around][0] in ENTRY_TAGS:
                self._close(around)
        entry = self._entry()
        if entry and tag in ("td", "th", "dd"):
            entry["naming"] = False
        entry = None
        if tag in ENTRY_TAGS or (tag in ("div", "article", "section") and re.search(ENTRY_CLASS, cls)):
            outer = self._entry()
            if outer:
                outer["naming"] = False
            entry = {"from": len(self.text), "name": None, "naming": False}
        self.stack.append((tag, entry))
        entry = entry or self._entry()
        if entry and entry["name"] is None and (tag in ("h3", "h4") or re.search("name|title", cls)):
            entry["name"], entry["naming"] = [], True

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        self.text.append(data)
        entry = self._entry()
        if entry and entry["naming"]:
            entry["name"] += [data, " "]

    def handle_endtag(self, tag):
        self.text.append(" ")
        entry = self._entry()
        if entry:
            entry["naming"] = False
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None)
        if at is not None:
            self._close(at)

    def _close(self, at):
        """Close what is open from ``at`` on; the text of an entry without a name belongs to the one around it."""
        while len(self.stack) > at:
            entry = self.stack.pop()[1]
            name = " ".join("".join(entry["name"] or []).split()).lower() if entry else ""
            if 2 <= len(name) <= 100:
                self.found.append((name, " ".join("".join(self.text[entry["from"] :]).split()).lower()))
                del self.text[entry["from"] :]
                self.text.append(" ")


def entries_of_page(html: str | None) -> list[tuple[str, str]]:
    """(name, text) of every named entry, lower-cased."""
    p = _Entries()
    p.feed((html or "").replace("<![", "< !["))  # the parser refuses unknown marked sections
    p.close()
    p._close(0)
    return p.found


def menu_item_annotations(pages: DataFrame) -> DataFrame:
    """Per list entry, table row or element of a menu-item class that has a name (h3, h4 or a class with
    name or title): page_id, name, nutrition within bounds, allergens and ingredients as the text says.

    A named entry inside another one keeps its text to itself; the text of a nested entry without a name (a table of
    amounts, a list of ingredients) is part of the entry around it. Null and empty pages have no entries.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *entry) for i, h in zip(pdf.page_id.astype("Int64"), pdf.html) for entry in entries_of_page(h)]
            yield pd.DataFrame(rows, columns=["page_id", "name", "t"]).astype({"page_id": "Int64"})

    items = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInPandas(run, "page_id bigint, name string, t string")

    def number(pattern, top):
        v = F.nullif(F.regexp_extract("t", pattern, 1), F.lit("")).cast("int")
        return F.when(v.between(1, top), v)

    def words(pattern):
        return F.filter(F.transform(F.split(F.regexp_extract("t", pattern, 1), ","), lambda w: F.trim(w)), lambda w: w != "")

    return items.select(
        "page_id",
        "name",
        F.coalesce(number(r"(\d{1,4})\s*(?:[-–]\s*\d{1,4}\s*)?(?:kcal|cal(?:ories?)?)\b", 5000), number(r"(?:kcal|cal(?:ories?)?)\s*[:=]\s*(\d{1,4})", 5000)).alias("calories"),
        number(r"(\d{1,4})\s*g?\s*prot(?:ein)?\b", 500).alias("protein"),
        number(r"(\d{1,4})\s*g?\s*carb(?:s|ohydrates?)?\b", 500).alias("carbs"),
        number(r"(\d{1,4})\s*g?\s*fat\b", 500).alias("fat"),
        words(r"(?:contains|allergens?)\s*[:=]\s*([a-z, ]+)").alias("allergens"),
        words(r"ingredients?\s*[:=]\s*([a-z, ()'-]+)").alias("ingredients"),
    )
