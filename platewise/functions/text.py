"""String column functions: names, keys, slugs, prices, similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sub(c: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def let(c: Column, f) -> Column:
    """f(c) with ``c`` computed once: a one-element transform names the value, so that expressions
    which use their input often stay as long as they are written.
    """
    return F.element_at(F.transform(F.array(c), f), 1)


# Entities, word lists and tags of menu texts.
NAMED_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " "}
ACRONYMS = "bbq blt nyc la dc xl xo pb mac diy og abv ipa ibu abts".split()
SMALL_WORDS = (
    "a an the and but or nor for yet so of in on at to by up as with from into over al de du la le el di da e con en y n".split()
)
NAME_TAGS = "v|vg|vegan|gf|gluten[ -]?free|df|dairy[ -]?free|nf|nut[ -]?free|new|hot|spicy|mild|contains nuts|vegetarian|halal|kosher"
SECTION_WORDS = (
    "appetizers?|starters?|entrees?|mains?|main +courses?|sides?|side +dishes?|desserts?|beverages?|drinks?|soups?|salads?|specials?|chef'?s? +specials?"
)


def decode_entities(x) -> Column:
    """HTML entities: named, decimal and hexadecimal."""
    c = reduce(lambda s, kv: F.regexp_replace(s, f"(?i){kv[0]}", kv[1]), NAMED_ENTITIES.items(), _c(x))
    def decoded(p):
        dec, hexa = F.regexp_extract(p, r"^&#([0-9]{1,7});$", 1), F.regexp_extract(p, r"(?i)^&#x([0-9a-f]{1,6});$", 1)
        code = F.when(dec != "", F.conv(dec, 10, 16)).when(hexa != "", hexa)
        # a code point as UTF-32 bytes, read as text
        return F.when(code.isNull(), p).otherwise(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))

    def numeric(c):
        # the text between entities stays, the entities become characters
        parts = F.regexp_extract_all(c, F.lit(r"(?is)&#x?[0-9a-f]+;|&|[^&]+"), F.lit(0))
        return F.when(c.rlike("(?i)&#x?[0-9a-f]+;"), F.array_join(F.transform(parts, decoded), "")).otherwise(c)

    return F.regexp_replace(let(c, numeric), "(?i)&amp;", "&")


def norm_space(x) -> Column:
    return F.trim(_sub(_c(x), ("[\\t\\n\\r\\u00A0\\u200B]+", " "), (" {2,}", " ")))


def norm_unicode(x) -> Column:
    c = F.translate(_c(x), "‘’‚‛“”„‟–—", "''''\"\"\"\"--")
    return F.replace(c, F.lit("…"), F.lit("..."))


def strip_numbers(x) -> Column:
    """Leading item numbers; "3-Cheese" keeps its number."""
    return F.trim(
        _sub(
            _c(x),
            (r"(?i)^#\d+[\s.\-:)]+", ""),
            (r"(?i)^no\.?\s*\d+[\s.\-:)]+", ""),
            (r"(?i)^[a-z]?\d+\s*[.):;]+\s*", ""),
            (r"(?i)^[a-z]?\d+\s*-\s+", ""),
        )
    )


def strip_price(x) -> Column:
    """A trailing price: after a dash, with a dollar sign, or with two decimals."""
    return F.trim(_sub(_c(x), (r"\s*[-–—]\s*\$?\d+(?:\.\d{2})?\s*$", ""), (r"\s+(?:\$\d+(?:\.\d{2})?|\d+\.\d{2})\s*$", "")))


def strip_calories(x) -> Column:
    return F.trim(_sub(_c(x), (r"(?i)\s*\(\s*\d+\s*(?:k?cal|calories?)\s*\)\s*", ""), (r"(?i)\s*[-–—]\s*\d+\s*(?:k?cal|calories?)\s*$", "")))


def strip_serving(x) -> Column:
    return F.trim(_sub(_c(x), (r"(?i)\s*\(\s*(?:serves?|for|feeds?)\s*\d+\s*\)\s*$", "")))


def strip_section(x) -> Column:
    return F.trim(_sub(_c(x), (rf"(?i)^(?:{SECTION_WORDS})\s*[:–—-]\s*", "")))


def strip_tags(x) -> Column:
    return F.trim(_sub(_c(x), (r"\s*[*†‡+]+\s*$", ""), (rf"(?i)\s*\(\s*(?:{NAME_TAGS})\s*\)\s*$", "")))


def strip_punctuation(x) -> Column:
    return F.trim(_sub(_c(x), (r"^[\s\-–—•·.,;:]+", ""), (r"[\s\-–—.,;:]+$", "")))


def strip_wine_number(x) -> Column:
    """A wine list's leading bin number and trailing bracketed tag."""
    return F.trim(_sub(_c(x), (r"^\s*\d{2,4}\s+(?=\D)", ""), (r"\s*\[[^\]]*\]\s*$", "")))


def _upper_first(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))


def norm_case(x) -> Column:
    """Title case for names that are all capitals or all small; others stay."""
    def word(w, i):
        short = (F.length(w) <= 3) & w.rlike("^[a-z]+$") & ~w.rlike("[aeiou]") & ~w.isin(SMALL_WORDS)
        title = F.array_join(F.transform(F.split(w, "-", -1), _upper_first), "-")
        return F.when(w.isin(ACRONYMS) | short, F.upper(w)).when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(title)

    def cased(c):
        one_case = (F.upper(c) == c) & c.rlike("[A-Z]") | (F.lower(c) == c) & c.rlike("[a-z]")
        return F.when(one_case, F.array_join(F.transform(F.split(F.lower(c), " ", -1), word), " ")).otherwise(c)

    return let(_c(x), cased)


def clean_name(x) -> Column:
    """The full name pipeline; null for what is left empty, too short or only digits."""
    c = _c(x)
    for step in (
        decode_entities,
        norm_unicode,
        norm_space,
        strip_numbers,
        strip_price,
        strip_calories,
        strip_serving,
        strip_section,
        strip_tags,
        strip_price,
        strip_punctuation,
        norm_case,
        norm_space,
    ):
        c = step(c)
    return let(c, lambda v: F.when((F.length(v) < 2) | v.rlike(r"^\d+$"), F.lit(None)).otherwise(v))


def clean_description(x) -> Column:
    """Decoded, one line, at most 500 characters; null when nothing is said."""
    c = strip_punctuation(norm_space(norm_unicode(decode_entities(F.regexp_replace(_c(x), "<[^>]*>", " ")))))
    return let(c, lambda v: F.when(F.length(v) < 3, F.lit(None)).otherwise(F.substring(v, 1, 500)))


def clean_category(x) -> Column:
    c = norm_case(strip_punctuation(norm_space(norm_unicode(decode_entities(x)))))
    return let(c, lambda v: F.when((F.length(v) < 2) | (F.length(v) > 60), F.lit(None)).otherwise(v))


def name_key(x) -> Column:
    """Key for finding the same item again: no tags, sizes or footnote marks."""
    return F.trim(
        _sub(
            F.lower(_c(x)),
            (r"\(\s*(?:v|vg|gf|df|nf|spicy|new|hot|small|large|regular)\s*\)", ""),
            (r"\s*-\s*(?:small|large|regular|medium)\s*$", ""),
            ("[*†‡]+", ""),
            (r"\s+", " "),
        )
    )


def name_key_sql(c: str) -> str:
    s = f"lower({c})"
    for pattern, to in (
        (r"\(\s*(?:v|vg|gf|df|nf|spicy|new|hot|small|large|regular)\s*\)", ""),
        (r"\s*-\s*(?:small|large|regular|medium)\s*$", ""),
        ("[*†‡]+", ""),
        (r"\s+", " "),
    ):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    return f"trim({s})"


def slug(x) -> Column:
    return _sub(F.lower(_c(x)), ("['’]", ""), ("[^a-z0-9]+", "-"), ("^-+|-+$", ""))


def stem(x) -> Column:
    """File name without folder, extension and version suffix."""
    return _sub(F.lower(_c(x)), (r"^.*/", ""), (r"\.[a-z0-9]+$", ""), (r"-v\d+$", ""))


def eval_key(x) -> Column:
    return F.trim(_sub(F.lower(_c(x)), ("[^a-z0-9 ]", ""), (" +", " ")))


def parse_price(x) -> Column:
    """The first number; null for market prices and mere dollar signs."""
    c = _c(x)
    number = F.regexp_extract(F.regexp_replace(c, ",", ""), r"(\d+(?:\.\d+)?)", 1)
    return F.when(c.rlike(r"(?i)market|\bmp\b") | (number == ""), F.lit(None)).otherwise(number.cast("decimal(8,2)"))


def parse_rating(x) -> Column:
    """Percentage and number of votes from a badge like ``95% (120)``."""
    c = _c(x)
    pct, n = F.regexp_extract(c, r"(\d{1,3})\s*%", 1), F.regexp_extract(F.regexp_replace(c, ",", ""), r"\((\d+)\+?\)", 1)
    return F.struct(F.nullif(pct, F.lit("")).cast("int").alias("pct"), F.nullif(n, F.lit("")).cast("int").alias("n"))


def parse_address(x) -> Column:
    """City and state of ``street, city, ST 12345, country``."""
    parts = F.transform(F.split(_c(x), ","), lambda p: F.trim(p))
    return F.struct(
        F.when(F.size(parts) >= 3, parts[F.size(parts) - 3]).alias("city"),
        F.when(F.size(parts) >= 3, F.nullif(F.regexp_extract(parts[F.size(parts) - 2], r"^([A-Z]{2})\b", 1), F.lit(""))).alias("state"),
    )


def letters(x) -> Column:
    """The letters, digits and blanks."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9 ]", ""))


def bigrams(x) -> Column:
    """Set of character pairs of the letters, digits and blanks."""

    def of(s):
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
        return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))

    return let(letters(x), of)


def trigrams(x) -> Column:
    """Set of character triples of each word, padded with two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(_c(x)), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")

    def of(w):
        p = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(p, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def dice_sets(a, b) -> Column:
    """Dice coefficient of two array columns taken as sets."""
    a, b = _c(a), _c(b)
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def jaccard_sets(a, b) -> Column:
    a, b = _c(a), _c(b)
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def dice(a, b) -> Column:
    return dice_sets(bigrams(a), bigrams(b))


def trigram_similarity(a, b) -> Column:
    return jaccard_sets(trigrams(a), trigrams(b))


def street(x) -> Column:
    """House number (or "") and street of an address."""
    c = F.trim(F.lower(_c(x)))
    number = F.regexp_extract(c, r"^(\d+)\s+.+?(?:,|$)", 1)
    name = F.when(number != "", F.regexp_extract(c, r"^\d+\s+(.+?)(?:,|$)", 1)).otherwise(F.split(c, ",")[0])
    return F.struct(number.alias("number"), F.trim(name).alias("name"))


def address_similarity(a, b) -> Column:
    """0 for different house numbers; else half for the same number and half for the street's likeness."""
    a, b = _c(a), _c(b)
    sa, sb = street(a), street(b)
    numbered = (sa["number"] != "") & (sb["number"] != "")
    score = F.when(numbered, 0.5).otherwise(0.0) + dice(sa["name"], sb["name"]) * 0.5
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(missing | numbered & (sa["number"] != sb["number"]), F.lit(0.0)).otherwise(score)


# What cooks do to food, and words that name none.
COOKING = "grilled fried baked roasted steamed sauteed sautéed raw fresh organic homemade crispy spicy smoked braised poached blanched".split()
LINKS = "with and the in on over served".split()


def food_queries(x, synonyms: dict[str, str] | None = None) -> Column:
    """Search phrases for an ingredient: its synonym alone, else its name without cooking words; of names
    of over three words then the word pairs and the long words, each by its synonym where it has one.
    """
    known = F.create_map(*[F.lit(v) for kv in (synonyms or {"": ""}).items() for v in kv])

    def named(w):
        return F.coalesce(F.try_element_at(known, w), w)

    def phrases(name):
        every = F.split(name, " ")
        words = F.filter(every, lambda w: (F.length(w) > 2) & ~w.isin(LINKS))
        rest = F.greatest(F.size(words) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: named(F.concat_ws(" ", a, b)))
        long = F.transform(F.filter(words, lambda w: F.length(w) > 4), named)
        return F.when(F.size(every) <= 3, F.array(name)).otherwise(F.array_distinct(F.concat(F.array(name), pairs, long)))

    c = norm_space(F.lower(_c(x)))
    bare = norm_space(F.regexp_replace(c, r"\b(?:" + "|".join(COOKING) + r")\b", ""))
    return F.when(F.try_element_at(known, c).isNotNull(), F.array(F.try_element_at(known, c))).otherwise(F.filter(let(bare, phrases), lambda q: q != ""))


def nutrition_near(page, name, window: int = 500) -> Column:
    """Calories and macros written within ``window`` characters after a dish's name."""
    at = F.instr(F.lower(_c(page)), F.lower(_c(name)))
    near = F.when(at > 0, F.substring(F.lower(_c(page)), at, F.lit(window)))

    def number(pattern):
        return F.nullif(F.regexp_extract(near, pattern, 1), F.lit("")).cast("double")

    return F.struct(
        number(r"(\d{2,4})\s*(?:k?cal|calories)\b").alias("calories"),
        number(r"(?:protein:?\s*(?=\d))?(\d+(?:\.\d+)?)\s*g\s*(?:of\s*)?protein").alias("protein"),
        number(r"(\d+(?:\.\d+)?)\s*g\s*(?:of\s*)?carb").alias("carbs"),
        number(r"(\d+(?:\.\d+)?)\s*g\s*(?:of\s*)?fat").alias("fat"),
    )


def glp1_label(name, description) -> Column:
    """Whether a menu calls the dish suited to GLP-1 medication."""
    both = F.lower(F.concat_ws(" ", _c(name), _c(description)))
    return both.rlike(r"\bglp-?1\b|\bozempic\b|\bwegovy\b|\bsemaglutide\b")
