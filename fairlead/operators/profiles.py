"""Profile documents: intake form and CV extraction to a nested profile, then to compiled matching rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import text as T
from fairlead.rules import fact_rules as fr


def split_list(c: Column | str) -> Column:
    """Items of a comma, semicolon or newline separated text."""
    items = F.transform(F.split(F.coalesce(T.col(c), F.lit("")), "[,;\n]"), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def with_scheme(c: str) -> Column:
    u = F.trim(F.coalesce(c, F.lit("")))
    return F.when((u != "") & ~u.rlike("^https?://"), F.concat(F.lit("https://"), u)).otherwise(u)


def _pick(options: Column, order: list[str], default: str) -> Column:
    return F.coalesce(*[F.when(F.array_contains(options, o), F.lit(o)) for o in order], F.lit(default))


def program_style(styles: Column) -> Column:
    research, course = F.array_contains(styles, "research_aligned"), F.array_contains(styles, "coursework")
    return (F.when(F.size(styles) == 0, "no_preference").when(F.array_contains(styles, "no_preference"), "no_preference")
            .when(research & course, "no_preference").when(research, "research_aligned").when(course, "coursework").otherwise(F.get(styles, F.lit(0))))


def degree_of_form(raw: Column) -> Column:
    return (F.when(raw.rlike("BSc|BE|BA"), "BSc").when(raw.rlike("MSc|MS"), "MSc").when(raw.rlike("PhD"), "PhD")
            .otherwise(F.trim(F.split_part(raw, F.lit("/"), F.lit(1)))))


def prefill(forms: DataFrame, chip_ids: dict[str, str] | None = None) -> DataFrame:
    """Nested profile from form columns; nothing is read from a CV here."""
    month = F.coalesce(F.try_element_at(T.literal(fr.MONTH_NUMBERS, "map<string,string>"), F.col("graduation_month")), F.lit("01"))
    graduated = F.coalesce("graduation_date", F.when((F.coalesce("graduation_month", F.lit("")) != "") & F.col("graduation_year").isNotNull(),
                                                      F.concat(F.col("graduation_year").cast("string"), F.lit("-"), month)))
    labels = T.literal(fr.ANTI_GOAL_LABELS, "map<string,string>")
    goals = F.transform(F.filter("anti_goals", lambda c: c != "other"), lambda c: F.coalesce(F.try_element_at(labels, c), c))
    goals = F.concat(goals, F.when(F.coalesce("anti_goals_other", F.lit("")) != "", F.array("anti_goals_other")).otherwise(T.no_strings()))
    flagship = F.slice(F.filter(F.transform(F.split(F.coalesce("flagship_projects", F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != ""), 1, 2)
    gpa = F.expr("try_cast(gpa AS DOUBLE)")
    known = T.str_array(list(chip_ids or {}))
    return forms.select(
        "user_id",
        F.struct(F.coalesce("full_name", F.lit("")).alias("full_name"), F.coalesce("nationality_code", "nationality", F.lit("")).alias("nationality"),
                 F.coalesce("current_country_code", "current_country").alias("current_country"), with_scheme("linkedin_url").alias("linkedin_url"),
                 F.nullif(with_scheme("github_url"), F.lit("")).alias("github_url")).alias("identity"),
        F.struct(F.coalesce("target_degree", F.lit("MSc")).alias("target_degree"), program_style(F.col("program_styles")).alias("program_style"),
                 F.when((F.col("target_intake_term") == "custom") & F.col("custom_intake_term").isNotNull(), F.col("custom_intake_term"))
                 .otherwise(F.coalesce("target_intake_term", F.lit(""))).alias("target_intake_term"),
                 _pick(F.col("funding_requirements"), fr.FUNDING_REQUIREMENTS, "full_only").alias("funding_requirement"),
                 F.col("target_regions"), split_list("target_countries").alias("target_countries_priority"),
                 split_list("target_universities").alias("target_universities"), F.col("target_fields"),
                 F.col("research_one_liner").alias("research_direction_one_liner"), F.lit(None).cast("string").alias("long_term_direction"), goals.alias("anti_goals"),
                 F.when(F.col("discovery_mode").isin("open", "target_list"), F.col("discovery_mode")).otherwise("open").alias("discovery_mode"),
                 F.coalesce("open_to_relocation", F.lit(True)).alias("open_to_relocation"), F.col("other_languages")).alias("preferences"),
        F.array(F.struct(degree_of_form(F.coalesce("degree_level", F.lit("BSc"))).alias("degree_level"),
                         F.when((F.col("field_of_study") == "Other") & F.col("field_of_study_other").isNotNull(), F.col("field_of_study_other"))
                         .otherwise(F.coalesce("field_of_study", F.lit(""))).alias("field"), F.coalesce("institution", F.lit("")).alias("institution"),
                         graduated.alias("graduation_date"), gpa.alias("gpa_value"), F.lit(True).alias("is_highest"))).alias("education"),
        F.when(F.coalesce("english_test", F.lit("")) != "", F.array(F.struct(
            F.col("english_test").alias("test_type"), F.expr("try_cast(english_score AS DOUBLE)").alias("overall_score"))))
        .otherwise(F.array().cast("array<struct<test_type:string,overall_score:double>>")).alias("language_tests"),
        F.transform(flagship, lambda n, i: F.struct(n.alias("name"), F.slice("target_fields", 1, 4).alias("tags"), (i == 0).alias("is_flagship"))).alias("projects"),
        split_list("connections").alias("connections"),
        F.filter("search_sources", lambda c: ~F.array_contains(known, c)).alias("manual_channels"),
        F.struct(F.lit("high").alias("confidence"), T.str_array(fr.PREFILL_REVIEW).alias("fields_needing_review")).alias("extraction_meta"))


def _elements(path: str) -> Column:
    """Raw items of a JSON list, of a separated text, or a single value (as JSON or plain text)."""
    raw = F.get_json_object("extraction", path)
    return T.let(raw, lambda r: F.when(r.isNull(), T.no_strings()).when(r.startswith("["), F.from_json(r, "array<string>"))
                 .when(r.startswith("{"), F.array(r)).otherwise(split_list(r)))


def _record(item: Column, key: str, *paths: str) -> Column:
    """A field of a JSON record, or the item itself when it is plain text and the field is its text key."""
    is_json = item.startswith("{")
    named = F.coalesce(*[F.get_json_object(item, "$." + p) for p in paths])
    return F.when(is_json, named).otherwise(F.trim(item) if key in paths else F.lit(None).cast("string"))


def _year(item: Column) -> Column:
    return F.coalesce(F.get_json_object(item, "$.year"), F.nullif(F.regexp_extract(F.coalesce(F.get_json_object(item, "$.date"), F.lit("")), r"(20\d{2})", 1), F.lit("")))


def normalize_extraction(extractions: DataFrame) -> DataFrame:
    """Common shapes of extraction JSON (column ``extraction``) to typed lists."""
    def experience(e: Column) -> Column:
        role = F.coalesce(_record(e, "role", "role", "title"), F.lit("Unknown role"))
        org = F.coalesce(_record(e, "role", "organization", "company"), F.lit("Unknown organization"))
        hinted = T.any_contains(F.lower(F.concat(role, F.lit(" "), org)), fr.RESEARCH_HINTS)
        return F.struct(role.alias("role"), org.alias("organization"),
                        F.slice(F.coalesce(F.from_json(F.get_json_object(e, "$.highlights"), "array<string>"), T.no_strings()), 1, 4).alias("highlights"),
                        F.coalesce(F.get_json_object(e, "$.is_research").cast("boolean"), hinted).alias("is_research"))

    def publication(p: Column) -> Column:
        doi = F.get_json_object(p, "$.doi")
        link = F.coalesce(doi.startswith("http"), F.lit(False))
        venue = F.array_join(F.filter(F.array(*[F.get_json_object(p, "$." + k) for k in ("venue", "publisher", "location")]), lambda v: v.isNotNull() & (v != "")), ", ")
        return F.struct(F.coalesce(_record(p, "title", "title"), F.lit("")).alias("title"), F.nullif(venue, F.lit("")).alias("venue"), _year(p).alias("year"),
                        F.when(link, F.element_at(F.split(doi, "/"), -1)).otherwise(doi).alias("doi"),
                        F.when(link, doi).otherwise(F.get_json_object(p, "$.url")).alias("url"))

    def project(p: Column) -> Column:
        return F.struct(F.coalesce(_record(p, "name", "name"), F.lit("")).alias("name"),
                        F.coalesce(F.from_json(F.get_json_object(p, "$.tags"), "array<string>"), T.no_strings()).alias("tags"),
                        F.coalesce(F.get_json_object(p, "$.is_flagship").cast("boolean"), F.lit(False)).alias("is_flagship"))

    def award(a: Column) -> Column:
        return F.struct(F.coalesce(_record(a, "title", "title", "name"), F.lit("")).alias("title"), _year(a).alias("year"))

    skills = F.get_json_object("extraction", "$.skills")
    grouped = F.array_distinct(F.flatten(F.map_values(F.from_json(skills, "map<string,array<string>>"))))
    return extractions.select(
        "user_id", F.transform(_elements("$.experiences"), experience).alias("experiences"),
        F.transform(_elements("$.publications"), publication).alias("publications"), F.transform(_elements("$.projects"), project).alias("projects"),
        F.when(skills.startswith("{"), grouped).otherwise(_elements("$.skills")).alias("skills"),
        F.transform(_elements("$.awards"), award).alias("awards"), _elements("$.connections").alias("connections"),
        F.transform(_elements("$.search_keywords"), F.lower).alias("search_keywords"),
        F.get_json_object("extraction", "$.preferences.long_term_direction").alias("long_term_direction"),
        F.coalesce(F.get_json_object("extraction", "$.extraction_meta.confidence"), F.lit("medium")).alias("confidence"),
        _elements("$.extraction_meta.fields_needing_review").alias("fields_needing_review"))


def merge_profile(prefilled: DataFrame, extracted: DataFrame) -> DataFrame:
    """CV lists win where they have items; identity and preferences stay with the form."""
    e = extracted.toDF(*["user_id"] + ["x_" + c for c in extracted.columns if c != "user_id"])
    j = prefilled.join(e, "user_id", "left")

    def cv(name: str) -> Column:
        return F.when(F.size("x_" + name) > 0, F.col("x_" + name)).otherwise(F.col(name))

    def cv_only(name: str) -> Column:
        return F.coalesce("x_" + name, F.lit(None))

    direction = F.coalesce("x_long_term_direction", "preferences.long_term_direction")
    return j.select(
        "user_id", "identity", F.col("preferences").withField("long_term_direction", direction).alias("preferences"), "education", "language_tests",
        cv_only("experiences").alias("experiences"), cv_only("publications").alias("publications"), cv("projects").alias("projects"),
        F.coalesce("x_skills", T.no_strings()).alias("skills"), cv_only("awards").alias("awards"), cv("connections").alias("connections"),
        F.coalesce("x_search_keywords", T.no_strings()).alias("search_keywords"), "manual_channels",
        F.struct(F.coalesce("x_confidence", "extraction_meta.confidence").alias("confidence"),
                 F.array_distinct(F.concat("extraction_meta.fields_needing_review", F.coalesce("x_fields_needing_review", T.no_strings()))).alias("fields_needing_review")).alias("extraction_meta"))


def validate_profiles(docs: DataFrame) -> DataFrame:
    """Adds errors: one text per broken rule."""
    def broken(cond: Column, text: str) -> Column:
        return F.when(cond, F.lit(text))

    highest = F.size(F.filter("education", lambda e: e["is_highest"]))
    errors = F.array_compact(F.array(
        broken(F.coalesce("identity.full_name", F.lit("")) == "", "identity.full_name: required"),
        broken(F.coalesce("identity.nationality", F.lit("")) == "", "identity.nationality: required"),
        broken(~F.coalesce(F.col("preferences.target_degree"), F.lit("")).isin(*fr.TARGET_DEGREES), "preferences.target_degree: unknown value"),
        broken(~F.coalesce(F.col("preferences.funding_requirement"), F.lit("")).isin(*fr.FUNDING_REQUIREMENTS), "preferences.funding_requirement: unknown value"),
        broken(F.size("preferences.target_regions") == 0, "preferences.target_regions: at least one"),
        broken(F.size("preferences.target_fields") == 0, "preferences.target_fields: at least one"),
        broken(F.size("education") == 0, "education: at least one"), broken(highest != 1, "education: exactly one highest degree"),
        broken((F.size("search_keywords") > 0) & (F.size("search_keywords") < 10), "search_keywords: at least 10 terms")))
    return docs.withColumn("errors", errors)


def _flat_map(keys: Column, table: dict[str, list[str]], keep_unknown: bool = True) -> Column:
    lookup = T.literal(table, "map<string,array<string>>")
    return F.flatten(F.transform(keys, lambda k: F.coalesce(F.try_element_at(lookup, k), F.array(k) if keep_unknown else T.no_strings())))


def compile_filter_config(docs: DataFrame) -> DataFrame:
    """Keyword filter of each profile (the envelope the gate takes)."""
    p = F.col("preferences")
    degree = F.coalesce(F.try_element_at(T.literal(fr.DEGREE_SYNONYMS, "map<string,array<string>>"), p["target_degree"]), F.array(F.lower(p["target_degree"])))
    listed = p["discovery_mode"] == "target_list"
    unis = F.when(listed, p["target_universities"]).otherwise(T.no_strings())
    tags = F.flatten(F.transform("projects", lambda x: x["tags"]))
    words = F.transform(F.filter(F.concat(p["target_fields"], "search_keywords", tags, unis), lambda t: t != ""), F.lower)
    rules = T.literal([{"code": c.replace("_", " "), "label": lab, "drops": fr.ANTI_GOAL_DROPS[c]} for c, lab in fr.ANTI_GOAL_LABELS.items()],
                      "array<struct<code:string,label:string,drops:array<string>>>")
    drops = F.flatten(F.flatten(F.transform(p["anti_goals"], lambda g: F.transform(
        F.filter(rules, lambda r: (g == r["label"]) | F.contains(F.lower(g), r["code"])), lambda r: r["drops"]))))
    return docs.select(
        "user_id", F.slice(F.concat(degree, T.str_array(fr.MUST_MATCH_FUNDING)), 1, 15).alias("must_match_any"),
        F.slice(F.array_distinct(words), 1, 30).alias("profile_match_any"),
        F.array_distinct(F.filter(F.concat(_flat_map(p["target_regions"], fr.REGION_ALIASES), p["target_countries_priority"]), lambda r: r != "")).alias("region_match_any"),
        F.array_distinct(F.filter(unis, lambda u: u != "")).alias("institution_match_any"),
        F.slice(F.array_distinct(F.concat(drops, T.str_array(fr.ALWAYS_DROP))), 1, 12).alias("hard_drop_any"),
        F.array(p["target_degree"]).alias("target_degree_levels"), p["funding_requirement"].alias("funding_requirement"),
        F.col("identity.nationality").alias("nationality"), p["discovery_mode"].alias("discovery_mode"))


def compile_eligibility_rules(docs: DataFrame) -> DataFrame:
    p = F.col("preferences")
    year = F.nullif(F.regexp_extract(p["target_intake_term"], r"(20\d{2})", 1), F.lit(""))
    langs = F.flatten(F.transform(p["other_languages"], lambda x: F.array(x, F.concat(x, F.lit(" language")))))
    near = F.when(~p["open_to_relocation"], F.slice(p["target_regions"], 1, 3)).otherwise(T.no_strings())
    ielts = F.get(F.filter("language_tests", lambda t: (t["test_type"] == "IELTS") & t["overall_score"].isNotNull()), F.lit(0))
    return docs.select(
        "user_id", F.coalesce(F.try_element_at(T.literal(fr.FUNDING_RULE, "map<string,string>"), p["funding_requirement"]), F.lit("full_only")).alias("require_funding"),
        T.str_array(fr.REJECT_PHRASES).alias("reject_if_text_contains"),
        F.array_distinct(F.concat(T.str_array(fr.BOOST_PHRASES), langs, near)).alias("boost_if_text_contains"),
        F.concat(year, F.when(F.contains(F.lower(p["target_intake_term"]), F.lit("fall")), "-09").otherwise("-01")).alias("target_intake"),
        ielts["overall_score"].alias("min_english_ielts"), F.col("identity.nationality").alias("nationality"), p["other_languages"].alias("other_languages"),
        p["open_to_relocation"].alias("open_to_relocation"))


def compile_ranking_config(docs: DataFrame) -> DataFrame:
    p = F.col("preferences")
    d = fr.RANKING_DEFAULTS
    return docs.select(
        "user_id", p["discovery_mode"].alias("discovery_mode"), F.when(p["discovery_mode"] == "target_list", 0.35).otherwise(d["university"]).alias("university_match_weight"),
        F.lit(d["region"]).alias("region_match_weight"), F.lit(d["interest"]).alias("interest_match_weight"), F.lit(d["language"]).alias("language_match_weight"),
        p["open_to_relocation"].alias("open_to_relocation"), "manual_channels")


def compile_ingestion_sources(selections: DataFrame, registry: DataFrame) -> DataFrame:
    """Enabled selections with their registry entry."""
    reg = registry.select(F.col("registry_id").alias("source"), "name", "url", "source_type", "fetch_interval_minutes", "authority")
    return selections.filter("enabled").join(reg, "source").select(
        "user_id", "source", "name", "url", F.coalesce("source_type", F.lit("rss")).alias("source_type"),
        F.coalesce("fetch_interval_minutes", F.lit(360)).alias("fetch_interval_minutes"), "authority",
        F.coalesce("selection_reason", F.lit("profile selection")).alias("selection_reason"))


def profile_fields(docs: DataFrame) -> DataFrame:
    """Flat matching profile of each document."""
    p = F.col("preferences")
    return docs.select(
        "user_id", F.col("identity.full_name").alias("name"),
        F.coalesce(F.nullif(p["long_term_direction"], F.lit("")), p["research_direction_one_liner"], F.lit("")).alias("long_term_goals"),
        p["target_fields"].alias("research_interests"), "skills", p["target_regions"].alias("target_regions"), p["target_universities"].alias("target_universities"),
        p["target_degree"].alias("degree_level"), "connections", p["discovery_mode"].alias("discovery_mode"), p["other_languages"].alias("other_languages"),
        p["funding_requirement"].alias("funding_requirement"))


def profile_readiness(users: DataFrame, submissions: DataFrame, docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Which pieces exist per user."""
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("user_id").distinct().withColumn(name, F.lit(True))

    compiled = artifacts.filter(F.col("filter_config").isNotNull() & F.col("eligibility_rules").isNotNull()
                                & F.col("ranking_config").isNotNull() & F.col("ingestion_sources").isNotNull())
    names = ["has_form_answers", "has_structured_profile", "has_compiled_artifacts"]
    out = users.select("user_id")
    for df, name in zip((submissions, docs, compiled), names):
        out = out.join(flag(df, name), "user_id", "left")
    return out.na.fill(False, names)


def purge_user(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the purged users."""
    return {name: df.join(gone.select("user_id"), "user_id", "left_anti") for name, df in tables.items()}
