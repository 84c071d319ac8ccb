"""Dietary safety: the allergen gate, the diet gate and warnings, as predicates on a dish row.

A dish row has name, description, flags (map of three-valued flags) and confidence. Keywords are
substring tests on purpose: a false alarm costs a dish, a miss may cost more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.categories import has_any
from platewise.functions.flags import flag, value


def _split(words: str) -> list[str]:
    return [w.strip() for w in words.split(",")]


UNKNOWN_MIN, CRITICAL_MIN, WARN_BELOW = 0.7, 0.85, 0.9

# Allergens, diets and their words.
CRITICAL = ("nut_free", "gluten_free", "dairy_free", "vegan", "vegetarian")
FLAG_OF_ALLERGEN = {"peanuts": "nut_free", "tree_nuts": "nut_free", "wheat": "gluten_free", "gluten": "gluten_free", "milk": "dairy_free"}
RISKY = {
    "nut_free": _split("pad thai, kung pao, satay, baklava, pesto, mole, dan dan, mapo, som tum, thai curry, massaman, panang, penang curry, pecan pie, praline, nougat, gianduja, romesco, muhammara, fesenjan, chinese chicken salad, caesar salad"),
    "gluten_free": _split(
        "ramen, udon, nabeyaki, spaghetti, linguine, penne, fettuccine, lo mein, chow mein, tiramisu, ladyfinger, croissant, baguette, pizza, calzone, gyoza, dumpling, wonton, couscous, bulgur, tabbouleh, seitan, fu, wheat noodle, "
        "orzo, farfalle, rigatoni, tortellini, gnocchi, beer-battered, tempura, katsu, tonkatsu, panko-crusted, teriyaki, hoisin, oyster sauce, miso soup, ramen broth"
    ),
    "dairy_free": _split(
        "alfredo, carbonara, mac and cheese, gratin, fondue, queso, tiramisu, cheesecake, butter chicken, cacio e pepe, white sauce, béchamel, bechamel, cream sauce, cream of mushroom, hollandaise, béarnaise, bearnaise, "
        "mashed potato, scalloped potato, au gratin, risotto, lobster bisque, chowder, creamy soup"
    ),
    "vegan": _split(
        "eel, unagi, omakase, bolognese, ragu, meatball, steak, burger, lamb, pork, bacon, prosciutto, sashimi, omelette, frittata, tiramisu, cheesecake, nigiri, kohada, uni bibimbap, taramasalata, kitsune udon, "
        "caesar dressing, worcestershire sauce, fish sauce, oyster sauce, dashi, bonito flakes, katsuobushi"
    ),
    "vegetarian": _split(
        "eel, unagi, omakase, sashimi, bolognese, ragu, meatball, steak, lamb chop, pork belly, bacon, prosciutto, kebab, caesar salad, ramen, pho, french onion soup, paella, clam chowder, bouillabaisse, worcestershire, fish sauce"
    ),
}
WORDS = {
    "peanuts": _split("peanut, peanuts, groundnut, groundnuts, monkey nut"),
    "tree_nuts": _split("almond, cashew, walnut, pecan, pistachio, hazelnut, macadamia, pine nut, brazil nut, coconut, chestnut, praline, nougat, marzipan, gianduja, frangipane"),
    "fish": _split("fish, salmon, tuna, cod, branzino, mackerel, anchovy, anchovies, catfish, trout, bass, halibut, swordfish, mahi, tilapia, snapper, flounder, sole, sea bass, striped bass, worcestershire"),
    "shellfish": _split("shrimp, crab, lobster, clam, mussel, oyster, squid, octopus, prawn, scallop, crawfish, crayfish, langoustine, abalone, barnacle"),
    "soybeans": _split("soy, tofu, edamame, miso, tempeh, soybean, soya, tamari, natto"),
    "sesame": _split("sesame, tahini, goma, til, benne"),
    "wheat": _split("wheat, flour, bread, naan, pita, tortilla, crouton, breadcrumb, panko, sourdough, toast, brioche, biscuit, pastry, croissant, baguette, ciabatta, focaccia, semolina, spelt, kamut, emmer, einkorn, durum"),
    "eggs": _split("egg, eggs, omelette, omelet, tamago, meringue, frittata, quiche, aioli, hollandaise, carbonara"),
    "milk": _split(
        "cheese, cream, butter, yogurt, milk, ricotta, burrata, mozzarella, paneer, mascarpone, ghee, whey, feta, pecorino, parmigiano, parmesan, brie, gouda, cheddar, gruyere, provolone, cacio, camembert, roquefort"
    ),
    "celery": _split("celery, celeriac, celery root, celery salt, celery seed, lovage"),
    "mustard": _split("mustard, mustard seed, mustard oil, dijon, whole-grain mustard, english mustard, american mustard"),
    "lupin": _split("lupin, lupine, lupin flour, lupin seed, lupin bean"),
    "sulphites": _split("sulphite, sulfite, sulphur dioxide, sulfur dioxide, dried fruit, wine sauce, wine reduction, pickled"),
    "molluscs": _split("snail, escargot, slug, abalone, squid ink, cuttlefish ink, whelk, periwinkle"),
}
MEAT = _split(
    "chicken, beef, pork, lamb, duck, turkey, veal, bacon, ham, sausage, salami, prosciutto, pepperoni, steak, ribeye, sirloin, brisket, chorizo, meat, eel, unagi, dashi, bonito, roe, caviar, uni, sea urchin, ikura, kohada, shad, tarama"
)
WORDS_OF_DIET = {
    "nut_free": WORDS["peanuts"] + WORDS["tree_nuts"],
    "gluten_free": WORDS["wheat"] + RISKY["gluten_free"],
    "dairy_free": WORDS["milk"] + RISKY["dairy_free"],
    "vegan": WORDS["milk"] + WORDS["eggs"] + WORDS["fish"] + WORDS["shellfish"] + RISKY["vegan"] + MEAT + _split("honey, nigiri, sashimi, anchovy"),
    "vegetarian": WORDS["fish"] + WORDS["shellfish"] + RISKY["vegetarian"] + MEAT,
}


def _says(keywords: list[str]) -> Column:
    return has_any(F.lower(F.coalesce("description", F.lit(""))), keywords) | has_any(_name(), keywords)


def _name() -> Column:
    return F.lower(F.coalesce("name", F.lit("")))


def _confidence() -> Column:
    return F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))


def _is(key: str, wanted: bool) -> Column:
    return value("flags", key).eqNullSafe(F.lit(wanted))


def _surely(key: str) -> Column:
    """An explicit true with enough confidence; more is asked of dishes known to be risky."""
    bar = F.when(has_any(_name(), RISKY.get(key, [])), WARN_BELOW).otherwise(CRITICAL_MIN)
    return _is(key, True) & (_confidence() >= bar)


def safe_from(allergen: str) -> Column:
    key = FLAG_OF_ALLERGEN.get(allergen)
    clear = ~_says(WORDS.get(allergen, [allergen]))
    if key is None:
        return clear
    return (_surely(key) if key in CRITICAL else ~_is(key, False)) & clear


def suits(diet: str) -> Column:
    if diet in CRITICAL:
        return _surely(diet) & ~_says(WORDS_OF_DIET[diet])
    f = flag("flags", diet)
    unknown = f["present"] & f["value"].isNull()
    return ~_is(diet, False) & ~(unknown & (_confidence() < UNKNOWN_MIN))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def allergen_gate(df: DataFrame, allergens: list[str]) -> DataFrame:
    """Rows without any of the excluded allergens."""
    return df.where(_all([safe_from(a) for a in allergens]))


def diet_gate(df: DataFrame, diets: list[str]) -> DataFrame:
    """Rows that keep every restriction."""
    return df.where(_all([suits(d) for d in diets]))


def diet_filter(df: DataFrame, diets: list[str]) -> DataFrame:
    """Containment: every requested flag is explicitly true."""
    return df.where(_all([_is(d, True) for d in diets]))


def diet_warnings(diets: list[str]) -> Column:
    """Labels for what is likely, traditionally different, or unknown; the second at most once."""
    risky = []
    out = []
    for d in diets:
        label = d.replace("_", " ")
        f = flag("flags", d)
        out.append(F.when(_is(d, True) & (_confidence() < WARN_BELOW), f"Likely {label} based on menu analysis, but not verified by the restaurant"))
        if d in CRITICAL:
            said = reduce(lambda a, b: a | b, risky, F.lit(False))
            hit = _is(d, True) & has_any(_name(), RISKY[d])
            out.append(F.when(hit & ~said, f"This dish traditionally contains ingredients related to {label} — verify with the restaurant before ordering"))
            risky.append(hit)
        out.append(F.when(f["present"] & f["value"].isNull() & (_confidence() >= UNKNOWN_MIN), f"{label} status unknown — exercise caution"))
    return F.filter(F.array(*out).cast("array<string>"), lambda w: w.isNotNull()) if out else F.array().cast("array<string>")
