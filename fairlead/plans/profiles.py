"""Profile document queries: forms and extractions derived from the users' customer rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.bindings import Bindings
from fairlead.functions import text as T
from fairlead.operators import profiles as B
from fairlead.plans.registry import query


def forms(b: Bindings) -> DataFrame:
    u = F.col("user_id")

    def pick(*values):
        out = F.lit(values[-1])
        for i, v in enumerate(values[:-1]):
            out = F.when(u % len(values) == i, F.lit(v)).otherwise(out)
        return out

    def words(*values):
        return F.filter(F.split(pick(*values), ","), lambda x: x != "")

    return b.profiles.select(
        "user_id", F.col("name").alias("full_name"), pick(None, "KE", "DE").cast("string").alias("nationality_code"), "nationality",
        F.lit(None).cast("string").alias("current_country_code"), pick("Kenya", "Germany").alias("current_country"),
        pick("linkedin.com/in/a", "https://linkedin.com/in/b", "").alias("linkedin_url"), pick("", "github.com/x").alias("github_url"),
        pick("MSc", "PhD", "Fellowship", "Mixed", "Diploma").alias("target_degree"),
        words("research_aligned,coursework", "research_aligned", "coursework", "", "no_preference").alias("program_styles"),
        pick("Fall 2027", "Spring 2026", "custom").alias("target_intake_term"), pick("Fall 2029", "winter").alias("custom_intake_term"),
        words("partial_ok", "full_only,partial_ok", "", "self_fund_possible").alias("funding_requirements"),
        F.when(u % 3 == 0, F.concat(T.str_array(["Germany", "UK"]), "target_regions")).otherwise(F.col("target_regions")).alias("target_regions"),
        pick("Kenya, Ghana;Chile", "", "Japan").alias("target_countries"), F.array_join("target_universities", "; ").alias("target_universities"),
        F.col("research_interests").alias("target_fields"), pick("Graph learning", None).cast("string").alias("research_one_liner"),
        words("bootcamp,other", "unpaid_internships", "", "online_only,non_stem").alias("anti_goals"), pick("no unpaid internships please", None, "").cast("string").alias("anti_goals_other"),
        F.when(u % 11 == 0, "weird").otherwise(F.col("discovery_mode")).alias("discovery_mode"), (u % 4 != 1).alias("open_to_relocation"), "other_languages",
        pick("BSc / BE", "MSc", "PhD", "Diploma / HND").alias("degree_level"), pick("Other", "Physics").alias("field_of_study"), pick("Ocean science", None, "Law").cast("string").alias("field_of_study_other"),
        pick("Uni A", None).cast("string").alias("institution"), pick(None, None, "2024-05").cast("string").alias("graduation_date"), pick("June", "Smarch", "").alias("graduation_month"),
        (2020 + u % 5).alias("graduation_year"), pick("3.6", "n/a", None).cast("string").alias("gpa"), pick("IELTS", "TOEFL", "").alias("english_test"), pick("7.5", "x").alias("english_score"),
        pick("P1, P2; P3", "Solo", "").alias("flagship_projects"), pick("Ada; Bob\nCy", "").alias("connections"), words("Chip 1,LinkedIn", "Chip 2", "LinkedIn,Fairs").alias("search_sources"))


def extractions(b: Bindings) -> DataFrame:
    u = F.col("user_id")
    rich = F.format_string(
        '{"experiences":[{"title":"Research Fellow %d","company":"Lab","highlights":["a","b","c","d","e"]},"Barista"],"publications":[{"title":"T%d","publisher":"ACM","doi":"https://doi.org/10.1/x%d","date":"May 2021"}],'
        '"projects":[{"name":"Proj","tags":["ocean","robots"]}],"skills":{"lang":["python","sql"],"tools":["sql","git"]},"awards":["Prize A",{"name":"Prize B","year":"2020"}],"search_keywords":"Alpha, Beta;Gamma",'
        '"connections":["Zed"],"preferences":{"long_term_direction":"Lead a lab"},"extraction_meta":{"confidence":"high","fields_needing_review":["skills","awards"]}}',
        "user_id", "user_id", "user_id")
    plain = F.lit('{"skills":["excel","word"],"experiences":"Tutor, Clerk","search_keywords":["k1","k2","k3","k4","k5","k6","k7","k8","k9","K10"]}')
    return b.profiles.filter(u % 4 != 3).select("user_id", F.when(u % 2 == 0, rich).otherwise(plain).alias("extraction"))


CHIPS = {f"Chip {i}": f"src{i}" for i in range(20)}


def documents(b: Bindings) -> DataFrame:
    return B.merge_profile(B.prefill(forms(b), CHIPS), B.normalize_extraction(extractions(b)))


@query("b01_prefill")
def b01(b: Bindings):
    p, e = F.col("preferences"), F.get("education", F.lit(0))
    return B.prefill(forms(b), CHIPS).select(
        "user_id", F.col("identity.nationality").alias("nationality"), F.col("identity.linkedin_url").alias("linkedin_url"), F.col("identity.github_url").alias("github_url"),
        p["program_style"].alias("program_style"), p["target_intake_term"].alias("intake"), p["funding_requirement"].alias("funding_requirement"),
        T.joined(p["target_countries_priority"]).alias("countries"), T.joined(p["target_universities"]).alias("universities"), T.joined(p["anti_goals"]).alias("anti_goals"),
        p["discovery_mode"].alias("discovery_mode"), e["degree_level"].alias("degree"), e["field"].alias("field"), e["graduation_date"].alias("graduated"), e["gpa_value"].alias("gpa"),
        F.get("language_tests", F.lit(0))["overall_score"].alias("english"), T.joined(F.transform("projects", lambda x: x["name"])).alias("projects"),
        T.joined(F.col("connections")).alias("connections"), T.joined(F.col("manual_channels")).alias("manual_channels"))


@query("b02_merge_profile")
def b02(b: Bindings):
    return documents(b).select(
        "user_id", T.joined(F.transform(F.coalesce("experiences", F.array().cast("array<struct<role:string,organization:string,highlights:array<string>,is_research:boolean>>")),
                                        lambda x: F.concat(x["role"], F.lit("@"), x["organization"], F.lit(":"), F.size(x["highlights"]).cast("string"), F.lit(":"), x["is_research"].cast("string")))).alias("experiences"),
        F.get("publications", F.lit(0))["venue"].alias("venue"), F.get("publications", F.lit(0))["doi"].alias("doi"), F.get("publications", F.lit(0))["year"].alias("pub_year"),
        T.joined(F.transform("projects", lambda x: x["name"])).alias("projects"), T.joined(F.col("skills")).alias("skills"),
        T.joined(F.transform(F.coalesce("awards", F.array().cast("array<struct<title:string,year:string>>")), lambda a: F.concat_ws(":", a["title"], a["year"]))).alias("awards"),
        T.joined(F.col("connections")).alias("connections"), T.joined(F.col("search_keywords")).alias("keywords"), F.col("preferences.long_term_direction").alias("direction"),
        F.col("extraction_meta.confidence").alias("confidence"), T.joined(F.col("extraction_meta.fields_needing_review")).alias("review"))


@query("b03_validate_profiles")
def b03(b: Bindings):
    return B.validate_profiles(documents(b)).select("user_id", T.joined(F.col("errors")).alias("errors"))


@query("b04_compile_filter_config")
def b04(b: Bindings):
    c = B.compile_filter_config(documents(b))
    return c.select("user_id", *[T.joined(F.col(x)).alias(x) for x in ("must_match_any", "profile_match_any", "region_match_any", "institution_match_any", "hard_drop_any")], "funding_requirement")


@query("b05_compile_eligibility_rules")
def b05(b: Bindings):
    c = B.compile_eligibility_rules(documents(b))
    return c.select("user_id", "require_funding", T.joined(F.col("boost_if_text_contains")).alias("boost"), "target_intake", "min_english_ielts", "nationality")


@query("b06_compile_ranking_config")
def b06(b: Bindings):
    return B.compile_ranking_config(documents(b)).select("user_id", "discovery_mode", "university_match_weight", "open_to_relocation", T.joined(F.col("manual_channels")).alias("manual_channels"))


def selections(b: Bindings) -> DataFrame:
    from fairlead.plans.discovery import chosen_sources

    return chosen_sources(b)


@query("b07_compile_ingestion_sources")
def b07(b: Bindings):
    s = selections(b).withColumn("enabled", F.col("priority") % 3 != 0)
    return B.compile_ingestion_sources(s, b.sources).select("user_id", "source", "name", "url", "source_type", "selection_reason")


@query("b08_profile_fields")
def b08(b: Bindings):
    f = B.profile_fields(documents(b))
    return f.select("user_id", "name", "long_term_goals", T.joined(F.col("research_interests")).alias("interests"), T.joined(F.col("skills")).alias("skills"), "degree_level", "discovery_mode")


@query("b09_profile_readiness")
def b09(b: Bindings):
    art = b.profiles.select("user_id", F.lit("{}").alias("filter_config"), F.lit("{}").alias("eligibility_rules"), F.lit("{}").alias("ranking_config"),
                            F.when(F.col("user_id") % 5 != 0, "{}").alias("ingestion_sources"))
    return B.profile_readiness(b.profiles, b.feedback, extractions(b), art)


@query("b10_purge_user")
def b10(b: Bindings):
    gone = b.profiles.filter(F.col("user_id") % 10 == 0)
    left = B.purge_user({"feedback": b.feedback.select("user_id"), "profiles": b.profiles.select("user_id"), "requirements": b.requirements.select("user_id")}, gone)
    out = None
    for name, df in left.items():
        part = df.groupBy().agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
