"""Expected verdicts of single candidates, and invariants of the gate."""

import pytest
from pyspark.sql import functions as F

from fairlead.functions import text as T
from fairlead.operators import gate as G

NARROW = G.ProfileTerms(
    disciplines=["marine biology", "oceanography", "hydrology"],
    regions=["Portugal", "Portuguese", "Iberia"], degrees=["PhD", "doctoral"],
    hard_drop=["summer camp", "open day"],
    extra_type_terms=["bursary", "travel grant"])

FILLER = ("The cafeteria serves lunch from noon until two, and the car park closes at night. "
          "Please keep the corridor free of bicycles. ") * 15
# One case for each rung of the ladder. key, title, url, summary, content, regions, detail
CASES = [
    ("plain_type", "Harbour Trust Scholarship", "https://harbour.example/scholarships/42", "", "", [], False),
    ("funded_type", "Fully Funded Fellowship at the Tidewater Institute", "https://tidewater.example/fellowships/7", "", "", [], False),
    ("region_only", "Doctoral Support Scheme", "https://lagoa.example/scheme", "", "", ["Portugal"], False),
    ("thin", "Kestrel Award", "https://kestrel.example/k/3", "", "", [], False),
    ("thin_read", "Kestrel Award", "https://kestrel.example/k/3", "", FILLER, [], True),
    ("rescued", "Call 2027", "https://reef.example/call", "",
     "The reef foundation offers a fully funded fellowship with a monthly stipend and tuition for doctoral candidates. Application deadline: 12 May 2027. Eligibility: applicants from all countries.", [], True),
    ("static_page", "Contact Us", "https://reef.example/contact", "", "", [], False),
    ("results_news", "Estuary Photography Prize winners announced", "https://estuary.example/news/prize", "", "", [], False),
    ("footer_words", "Fully Funded PhD Scholarship in Oceanography", "https://tidewater.example/scholarships/ocean", "",
     "Closing date 3 June. See our privacy policy and cookie settings. About us: a school by the sea.", [], True),
    ("own_drop", "Estuary Summer Camp Scholarship", "https://estuary.example/camp", "", "", [], False),
    ("list_page", "Top 25 Scholarships for Divers in 2027", "https://divers.example/scholarships/top-25/", "", "", [], False),
    ("opinions", "Tidewater Institute Reviews", "https://tidewater.example/reviews/", "", "", [], False),
    ("unfit", "Scholarship Scheme 2027", "https://harbour.example/s", "", "", [], False),
    ("fit", "Scholarship Scheme 2027 in Marine Biology, Portugal", "https://harbour.example/s", "", "", [], False),
]


@pytest.fixture(scope="module")
def results(spark):
    schema = "key string, title string, url string, summary string, content string, source_regions array<string>, detail_fetched boolean"
    rows = G.evaluate(spark.createDataFrame(CASES, schema), NARROW).select(
        "key", "verdict", "reason", "score", "sufficiency", "type_label", F.col("region.found_in").alias("region_in"), F.col("discipline.matched").alias("disc"))
    return {r["key"]: r for r in rows.collect()}


@pytest.mark.parametrize("key", ["rescued", "footer_words"])
def test_admitted(results, key):
    assert results[key]["verdict"] == "admit"


@pytest.mark.parametrize("key", ["thin_read", "static_page", "results_news", "own_drop", "list_page", "opinions"])
def test_rejected(results, key):
    assert results[key]["verdict"] == "reject"


@pytest.mark.parametrize("key", ["plain_type", "funded_type", "unfit", "fit"])
def test_fit_never_rejects(results, key):
    assert results[key]["verdict"] != "reject"


def test_details(results):
    assert results["thin"]["verdict"] == "investigate"
    assert results["results_news"]["reason"].startswith("hard_negative")
    assert results["thin_read"]["sufficiency"] == 1.0
    assert results["region_only"]["region_in"] == "registry"
    assert results["fit"]["score"] > results["unfit"]["score"]
    assert results["plain_type"]["type_label"] == "scholarship"


def test_text_matching(spark):
    def find(term, text):
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(T.find_terms(T.normalize_text("t"), T.term_rules([term]))).first()[0]

    assert find("ai", "the captain said so") == []
    assert find("ms", "terms of the farms") == []
    assert find("ai", "ethics of ai, briefly") == ["ai"]
    assert find("partly paid", "a partly-paid berth") == ["partly paid"]
    df = spark.createDataFrame([("Partly-Paid Bursary (2027)!", "up to $2,500 a term", "grants of €750.000 in all")], "a string, b string, c string")
    r = df.select(T.normalize_text("a"), T.find_amounts("b"), T.find_amounts("c")).first()
    assert r[0] == "partly-paid bursary 2027" and r[1] == ["$2,500"] and r[2] == ["€750.000"]


def test_compatibility_forms_are_taken_apart(spark):
    texts = ["ﬁne ﬂags oﬃce", "½ of the ﬀ", "Ｆｕｌｌ ｗｉｄｔｈ", "x² ™ № … Ⅳ", "Ärger naïve Ñandú ς", "plain, text/2-3 + 5%", "a\u0301b ệ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize_text("t")).collect()
    assert [r[0] for r in got] == [T.normalize_py(t) for t in texts]


def test_data_terms_equal_planned_terms(spark, tables):
    terms = ["Research grant", "monthly stipend", "summer-school", "Masters programme", "masters  programme"]
    df = tables.listings.select(T.normalize_text(F.concat_ws(" ", "title", "summary")).alias("t")).withColumn("terms", T.str_array(terms))
    a, b = T.find_terms(F.col("t"), T.term_rules(terms)), T.find_terms(F.col("t"), T.term_rules_from("terms"))
    assert df.filter(a != b).count() == 0


def test_scores_stay_in_range(tables):
    from fairlead.plans.gate import decisions

    bad = decisions(tables).filter(~F.col("score").between(0, 1) | ~F.col("sufficiency").between(0, 1))
    assert bad.count() == 0


def test_a_signal_alone_needs_no_verdict(tables):
    """Amounts are only searched for the funding signal and the verdict."""
    from fairlead.plans.gate import decisions

    plan = lambda *cols: decisions(tables).select(*cols)._jdf.queryExecution().optimizedPlan().toString()
    assert "dollars?" in plan("listing_id", "verdict") and "dollars?" not in plan("listing_id", "application")


def test_triage_judges_once(spark, tables):
    from fairlead.plans.gate import LANE_COLUMNS, decisions

    judged = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(verdict):
        judged.add(1)
        return verdict

    d = decisions(tables).select(*LANE_COLUMNS).withColumn("verdict", counted("verdict"))
    lanes = G.triage(d, budget=2).collect()
    assert judged.value == len(lanes) == tables.listings.count()


def test_ascii_and_other_texts_are_normalised_alike(spark):
    texts = ["Tab\tand\x0bline\x1cbreak \r\n AT&T -- 'Co-op' (5%)!", "", "  ", "a_b/c+d, $5.00 [x]^`{|}~\x00\x7f"]
    both = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize_text("t").alias("a"), T.normalize_text(F.concat("t", F.lit(" é"))).alias("b"))
    assert [(r["a"], r["b"]) for r in both.collect()] == [(T.normalize_py(t), T.normalize_py(t + " é")) for t in texts]


def test_terms_meet_first_and_last_words(spark):
    df = spark.createDataFrame([("research and a grant; research-grants, travel/grant, ph d",), ("",), ("up to, grantresearch",)], "t string")
    terms = ["grant", "research grant", "travel grant", "ph d", "up to", "research grants"]
    got = [r[0] for r in df.select(T.find_terms(F.col("t"), T.term_rules(terms))).collect()]
    assert got == [["grant", "travel grant", "ph d", "research grants"], [], ["up to"]]


def test_texts_are_judged_where_they_are_read(spark):
    """Items get the regions of their source without being dealt out by source, which would put all texts of one in a task."""
    from conftest import SF
    from fairlead.bindings import Bindings
    from fairlead.plans.gate import items

    plan = items(Bindings(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_normal_form_of_all_ascii_characters(spark):
    """Texts of ASCII only take the same pattern as others."""
    told = ["".join(map(chr, range(1, 128))), "".join(f"a{chr(c)}B" for c in range(1, 128)), "é" + "".join(f"a{chr(c)}B" for c in range(1, 128))]
    got = spark.createDataFrame([(t,) for t in told], "t string").select(T.normalize_text("t").alias("n")).collect()
    keep = "_$%.,/+-"
    want = [" ".join("".join(c if c.isalnum() or c in keep else " " for c in t.lower().replace("é", "e")).split()) for t in told]
    assert [r["n"] for r in got] == want
