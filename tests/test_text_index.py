"""Stems against the algorithm's published sample, and the index against a search without one."""

import re

import pytest
from pyspark.sql import functions as F

from platewise.functions.stems import stem, stem_column
from platewise.plans import search as SE
from platewise.plans import text_index as TI

# word and stem, from the published sample vocabulary
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol
consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir
conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave
knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight
knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot"""

# forms of one word that menus and requests use, and the stem they share
FORMS = {
    "grill": "grill grills grilled grilling", "roast": "roast roasts roasted roasting", "fri": "fry fries fried", "bake": "bake bakes baked baking", "spici": "spicy", "berri": "berry berries", "tomato": "tomato",
    "noodl": "noodle noodles", "dumpl": "dumpling dumplings", "stuf": "stuffed stuffing", "chop": "chop chops chopped chopping", "dri": "dry dried dries", "hop": "hop hops hopping hopped", "hope": "hope hopes hoping hoped",
    "relat": "relate related relating relation relations relational", "oper": "operate operated operating operation operator operators", "general": "general generally", "generous": "generous generously",
    "communic": "communicate communicated communication", "eat": "eat eats eating", "agre": "agreed agreeing agrees", "happi": "happy happiness", "happili": "happily", "use": "use uses used using", "easili": "easily", "die": "die dies died dying",
    "control": "control controls controlled controlling", "rate": "rate rates rated", "sky": "sky skies", "poach": "poach poached poaches poaching", "simmer": "simmer simmered simmering simmers", "crispi": "crispy",
}


def test_stems():
    words = SAMPLE.split()
    wrong = [(a, b, stem(a)) for a, b in zip(words[::2], words[1::2]) if stem(a) != b]
    wrong += [(w, s, stem(w)) for s, ws in FORMS.items() for w in ws.split() if stem(w) != s]
    assert not wrong
    assert [stem(w) for w in ("", "a", "été", "x2y", "youth", "boyish", "y", "o'clock", "cat's")] == ["", "a", "été", "x2y", "youth", "boyish", "y", "o'clock", "cat"]


def test_stem_column(spark):
    df = spark.createDataFrame([("grilled",), (None,), ("",), ("grilled",)], "w string")
    assert [r[0] for r in df.select(stem_column("w")).collect()] == ["grill", None, "", "grill"]


ROWS = [
    (1, "Grilled Chicken Bowl", "chicken grilled over rice with the herbs"),
    (2, "Fried Rice", "egg fried rice, no chicken"),
    (3, "The Who", "what was it about"),
    (4, None, "grill the chicken; chicken grilling all day"),
    (5, "Chickens", None),
    (6, "", ""),
    (7, "Rice rice RICE", "chicken-rice bowls of chicken"),
    (8, "Bowl of noodles", "noodles and rice in a bowl"),
]
WEIGHTS = {"name": 1.0, "description": 0.4}


def by_hand(q, english):
    """Row ids that meet a request."""
    groups, phrases, never = SE.parse_query(q)
    out = set()
    norm = stem if english else str
    for i, *parts in ROWS:
        fields = [[norm(w) if not (english and w in SE.STOP_WORDS) else None for w in re.findall(r"[^\W_]+", (p or "").lower())] for p in parts]
        said = {w for f in fields for w in f if w}
        asked = [[norm(w) for w in g if not (english and w in SE.STOP_WORDS)] for g in groups]
        asked = [g for g in asked if g]
        placed = [[None if english and w in SE.STOP_WORDS else norm(w) for w in p.split()] for p in phrases]
        ok = bool(asked or placed) and all(said & set(g) for g in asked) and not said & {norm(w) for w in never}
        for p in placed:
            ok = ok and any(all(w is None or w == f[k + j] for j, w in enumerate(p)) for f in fields for k in range(len(f) - len(p) + 1))
        if ok:
            out.add(i)
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    df = spark.createDataFrame(ROWS, "id int, name string, description string")
    TI.build(df, list(WEIGHTS), "id", path, 16)
    return df, path


@pytest.mark.parametrize("q", ["chicken", "grill chicken", "rice -noodle", "noodle or egg", '"fried rice"', 'chicken "grilled over"', '"grill the chicken"', "bowls", "who", "the", "zebra", "-rice", "rice or rice chicken", '"rice bowls" chicken', "fried or bowl rice -egg"])
def test_index_search(spark, index, q):
    df, path = index
    got = [(r.key, round(r.rank, 9)) for r in TI.search(spark, path, q, list(WEIGHTS.values()), buckets=16).collect()]
    want = by_hand(q, True) or by_hand(q, False)
    assert {k for k, _ in got} == want
    assert got == sorted(got, key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("q", ["chicken", "rice -noodle", '"fried rice"', "rice chicken", "noodle or egg"])
def test_index_ranks_like_the_search_without_one(spark, index, q):
    df, path = index
    got = {r.key: round(r.rank, 9) for r in TI.search(spark, path, q, list(WEIGHTS.values()), buckets=16).collect()}
    assert got == {r.id: round(r["rank"], 9) for r in SE.token_search(df, q, WEIGHTS, "id").collect()}


def test_a_request_reads_its_own_folders(spark, index):
    _, path = index
    files = TI.hits(spark, path, [stem("noodles")], 16).inputFiles()
    every = spark.read.parquet(path).inputFiles()
    assert 0 < len({f.split("bucket=")[1].split("/")[0] for f in every}) and len(TI.hits(spark, path, [stem("noodles")], 16).select("stem").distinct().collect()) == 1
    plan = TI.hits(spark, path, [stem("noodles")], 16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "[bucket") or "bucket#" in plan.split("PartitionFilters")[1]
    assert "PushedFilters" in plan and "stem" in plan.split("PushedFilters")[1] and files


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "id int, name string, description string")
    assert TI.postings(df, list(WEIGHTS), "id").count() == 0
