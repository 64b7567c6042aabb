"""Registry rows and place exports into one company table: normalise, deduplicate, exclude, score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from hireatlas import rules, schemas
from hireatlas.functions.geo import haversine_km
from hireatlas.functions.text import filled, pick_first, strip, to_ascii, usable
from hireatlas.functions.urls import clean_domain
from hireatlas.operators.industry import classify


def clean_address(street: Column, post_code: Column, city: Column) -> Column:
    return to_ascii(F.concat_ws(", ", filled(street), filled(post_code), filled(city)))


def picked_address(addresses: Column, source_city: Column) -> Column:
    """First address, overridden field by field by the first one in the source city.

    A field the matching address lacks keeps the value of the first address.
    """
    wanted = strip(source_city)
    match = F.get(F.filter(addresses, lambda a: (strip(a["city"]) == wanted) & (wanted != "")), F.lit(0))
    first = F.get(addresses, F.lit(0))
    return F.struct(*[F.coalesce(match[f], first[f]).alias(f) for f in ("street", "postCode", "city")])


def official_name(names: Column) -> Column:
    """Name in force: not ended before ended, type 1 before the rest, newest registration, list order."""

    def rank(n: Column, position: Column) -> Column:
        return F.struct(
            F.when(filled(n["endDate"]).isNull(), 0).otherwise(1).alias("ended"),
            F.when(n["type"] == "1", 0).otherwise(1).alias("other_type"),
            F.coalesce(n["registrationDate"], F.lit("")).alias("registered"),
            position.alias("position"),
            n["name"].alias("name"),
        )

    def order(a: Column, b: Column) -> Column:
        def ascending(field: str, then: Column) -> Column:
            return F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(then)

        by_date = (
            F.when(a["registered"] > b["registered"], -1)
            .when(a["registered"] < b["registered"], 1)
            .otherwise(ascending("position", F.lit(0)))
        )
        return ascending("ended", ascending("other_type", by_date))

    ranked = F.array_sort(F.transform(names, rank), order)
    return F.get(ranked, F.lit(0))["name"]


def _registry_shape(rows: DataFrame) -> DataFrame:
    """Bring the spellings a registry export may use to one schema.

    The id and the business line may be plain or nested, and lists may come as text.
    """
    types = {f.name: f.dataType for f in rows.schema}

    def plain(name: str, field: str) -> list[Column]:
        kind = types.get(name)
        if isinstance(kind, T.StructType):
            return [F.col(name)[field].cast("string")] if field in kind.fieldNames() else []
        return [F.col(name).cast("string")] if kind is not None else []

    ids = plain("businessId", "value") + plain("business_id", "value")
    nested = [c for n in ("main_business_line", "mainBusinessLine") if isinstance(types.get(n), T.StructType) for c in plain(n, "type")]
    flat = [c for n in ("main_business_line", "mainBusinessLine") if not isinstance(types.get(n), T.StructType) for c in plain(n, "type")]
    fixed = {"businessId": pick_first(*ids), "mainBusinessLine": F.struct(pick_first(*nested, *flat).alias("type"))}
    for name in ("names", "addresses", "companyForms"):
        if isinstance(types.get(name), T.StringType):
            text = F.regexp_replace(name, r":\s*None\b", ": null")
            fixed[name] = F.from_json(text, schemas.REGISTRY[name].dataType)
    return schemas.conform(rows.withColumns(fixed).drop("business_id", "main_business_line"), schemas.REGISTRY, keep_extra=True)


def normalize_registry(rows: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Flat company rows from nested registry rows."""
    rows = _registry_shape(rows)
    address = picked_address(F.col("addresses"), F.col("_source_city"))
    shaped = rows.withColumn("_address", address).select(
        filled("businessId").alias("business_id"),
        F.coalesce(filled(official_name(F.col("names"))), F.col("name"), F.lit("")).alias("name"),
        pick_first(F.col("_address.street"), "street").alias("street"),
        pick_first(F.col("_address.postCode"), "postCode").alias("post_code"),
        pick_first(F.col("_address.city"), "city", "domicile", "_source_city").alias("city"),
        "_source_city",
        "domicile",
        F.coalesce(F.col("mainBusinessLine.type"), F.lit("")).alias("industry_raw"),
        company_form(F.col("companyForm"), F.col("companyForms")).alias("company_form"),
        *[c for c in rows.columns if c not in schemas.REGISTRY.fieldNames()],
    )
    return shaped.withColumns(
        {
            "business_id": F.coalesce("business_id", F.lit("")),
            "full_address": clean_address(F.col("street"), F.col("post_code"), F.col("city")),
            "industry": classify(F.col("industry_raw"), groups or rules.INDUSTRY_GROUPS),
        }
    )


def company_form(form: Column, forms: Column) -> Column:
    """Legal form in capitals: the plain field, else the first listed form's name or type."""
    first = F.get(forms, F.lit(0))
    return F.upper(F.coalesce(filled(form), filled(first["name"]), filled(first["type"]), F.lit("")))


def is_housing_name(name: Column) -> Column:
    folded = F.translate(F.lower(strip(F.coalesce(name, F.lit("")))), "öäå", "oaa")
    return folded.rlike("|".join(f"(?:{p})" for p in rules.HOUSING_NAME_PATTERNS))


def exclude_reason(form: Column, name: Column) -> Column:
    """Why a company is left out: its legal form, else its name; null when it stays."""
    plain = F.translate(form, "ÖÄÅÕ", "OAAO")
    return F.when(plain.isin(rules.HOUSING_FORMS), F.concat(F.lit("company_form:"), form)).when(
        is_housing_name(name), F.lit("name_match:housing")
    )


def split_excluded(companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shortlist and excluded rows, the latter with their reason."""
    marked = companies.withColumn("excluded_reason", exclude_reason(F.col("company_form"), F.col("name")))
    return marked.where(F.col("excluded_reason").isNull()), marked.where(F.col("excluded_reason").isNotNull())


def industry_gate(line: Column, allow: list[str], deny: list[str]) -> Column:
    """``struct<pass, reason, hard>``: a denied word fails hard, a missing allowed word fails softly."""
    text = F.lower(F.coalesce(line, F.lit("")))
    allow = [w.lower() for w in allow if w]
    deny = [w.lower() for w in deny if w]

    def verdict(ok: bool, reason: str | None, hard: bool) -> Column:
        return F.struct(
            F.lit(ok).alias("pass"), F.lit(reason).cast("string").alias("reason"), F.lit(hard).alias("hard")
        )

    cases = [(w, verdict(False, f"blacklist:{w}", True)) for w in deny]
    cases += [(w, verdict(True, f"whitelist:{w}", False)) for w in allow]
    rest = verdict(False, "not_in_whitelist", False) if allow else verdict(True, None, False)
    return reduce(lambda tail, case: F.when(F.contains(text, F.lit(case[0])), case[1]).otherwise(tail), reversed(cases), rest)


def industry_filter(companies: DataFrame, line: str, allow: list[str], deny: list[str]) -> DataFrame:
    return companies.where(industry_gate(F.col(line), allow, deny)["pass"])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key.

    Spark applies the rank limit before the shuffle as well, so a hot key sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def first_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


def deduplicate(companies: DataFrame) -> DataFrame:
    """One row per id, geocoded rows first, then ingest order; rows with a blank id all stay."""
    has_id = filled("business_id").isNotNull()
    no_geo = F.col("lat").isNull() | F.col("lon").isNull()
    best = first_per_key(companies.where(has_id), ["business_id"], [no_geo.asc(), F.col("ord").asc()])
    return best.unionByName(companies.where(~F.coalesce(has_id, F.lit(False))))


def union_distinct(batches: list[DataFrame], key: str) -> DataFrame:
    """Rows of all batches, the first one per id; rows without an id all stay."""
    tagged = [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)]
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    best = first_per_key(everything.where(F.col(key).isNotNull()), [key], [F.col("_batch").asc(), F.col("ord").asc()])
    return best.unionByName(everything.where(F.col(key).isNull())).drop("_batch")


def key_violations(df: DataFrame, key: str = "business_id", limit: int | None = None) -> DataFrame:
    """Blank and repeated keys with their counts; ``limit`` keeps that many examples of a report."""
    text = F.coalesce(filled(F.col(key).cast("string")), F.lit(""))
    counted = df.groupBy(text.alias("key")).agg(F.count("*").alias("n_rows"))
    kind = F.when(F.col("key") == "", F.lit("blank")).otherwise(F.lit("duplicate"))
    bad = counted.where((F.col("key") == "") | (F.col("n_rows") > 1)).select("key", kind.alias("problem"), "n_rows")
    return bad if limit is None else bad.orderBy("problem", "key").limit(limit)


def parse_address(address: Column) -> Column:
    """``struct<street, post_code, city>`` of a comma separated address.

    A trailing country is dropped; leading digits of the city part are the postcode; a lone part
    is both street and city.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), strip), lambda p: p != "")
    n = F.size(parts)
    ends_in_country = F.lower(F.get(parts, n - 1)).isin("finland", "suomi") & (n >= 2)
    place = F.when(ends_in_country, F.get(parts, n - 2)).otherwise(F.get(parts, n - 1))
    words = F.split(place, r"\s+")
    post_code = F.when(F.get(words, F.lit(0)).rlike(r"^\d+$"), F.get(words, F.lit(0))).otherwise(F.lit(""))
    after = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    city = F.when((post_code != "") & (F.size(words) > 1), after).otherwise(place)
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("street"),
        F.coalesce(post_code, F.lit("")).alias("post_code"),
        F.coalesce(city, F.lit("")).alias("city"),
    )


def place_rows(places: DataFrame) -> DataFrame:
    """Company rows out of place rows that carry their station as ``station_*`` columns."""
    where = parse_address(F.col("formatted_address"))
    distance = haversine_km(F.col("station_lat"), F.col("station_lon"), F.col("lat"), F.col("lon"))
    text, zero = F.lit(""), F.lit(0).cast("long")
    return places.withColumn("_where", where).select(
        *(["ord"] if "ord" in places.columns else []),
        F.coalesce(strip("place_id"), text).alias("business_id"),
        "name",
        F.col("formatted_address").alias("full_address"),
        F.col("_where.street").alias("street"),
        F.col("_where.post_code").alias("post_code"),
        F.col("_where.city").alias("city"),
        F.col("_where.city").alias("_source_city"),
        "lat",
        "lon",
        F.col("station_name").alias("nearest_station"),
        distance.alias("distance_km"),
        F.col("website").alias("website_url"),
        text.alias("company_domain"),
        F.lit(0.0).alias("score"),
        text.alias("score_reasons"),
        text.alias("excluded_reason"),
        F.lit("neutral").alias("status"),
        F.lit(False).alias("hide_flag"),
        text.alias("industry_raw"),
        F.lit("other").alias("industry"),
        text.alias("main_business_line"),
        text.alias("company_form"),
        F.lit(False).alias("recruiting_active"),
        zero.alias("job_count_total"),
        zero.alias("job_count_new_since_last"),
        text.alias("tags"),
        F.lit("google_places_new").alias("source"),
    )


def closest_station_row(rows: DataFrame, tie_break: list[str] | None = None) -> DataFrame:
    """Per place id the row of its closest station; a missing distance comes last."""
    ties = tie_break or [c for c in ("ord",) if c in rows.columns] or ["nearest_station"]
    kept = rows.where(filled("business_id").isNotNull())
    return first_per_key(kept, ["business_id"], [F.col("distance_km").asc_nulls_last(), *[F.col(c) for c in ties]])


def master_from_places(exports: list[tuple[DataFrame, str, float, float]]) -> DataFrame:
    """Company table out of one place export per station."""
    batches = [
        df.withColumns({"station_name": F.lit(name), "station_lat": F.lit(lat), "station_lon": F.lit(lon), "ord": F.lit(i)})
        for i, (df, name, lat, lon) in enumerate(exports)
    ]
    return closest_station_row(place_rows(reduce(DataFrame.unionByName, batches)))


def company_domain(*candidates: str) -> Column:
    """Domain from the first usable candidate column."""
    return F.coalesce(*[F.nullif(clean_domain(c), F.lit("")) for c in candidates], F.lit(""))


def last_row(df: DataFrame, key: str, columns: list[str], order: str = "ord") -> DataFrame:
    """``key`` and ``_last``, the struct of columns of each key's last row; without the order column the greatest struct."""
    whole = F.struct(*columns)
    rank = F.struct(order, whole) if order in df.columns else whole
    return df.groupBy(key).agg(F.max_by(whole, rank).alias("_last"))


def domain_ladder(companies: DataFrame, domain_map: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """Add ``domain``: the row's own, else the mapped one, else the suggested one, else empty.

    Of several entries of an id the last one by ``ord`` counts.
    """

    def lookup(df: DataFrame, name: str) -> DataFrame:
        known = df.where(usable("domain").isNotNull()).withColumns({"business_id": strip("business_id"), name: usable("domain")})
        return last_row(known, "business_id", [name]).select("business_id", f"_last.{name}")

    out = companies.withColumn("_own", usable("domain")).drop("domain").join(lookup(domain_map, "_mapped"), "business_id", "left")
    ladder = ["_own", "_mapped"]
    if suggestions is not None:
        out = out.join(lookup(suggestions, "_suggested"), "business_id", "left")
        ladder.append("_suggested")
    return out.withColumn("domain", F.coalesce(*ladder, F.lit(""))).drop(*ladder)


def fill_domains(domains: DataFrame, websites: DataFrame) -> DataFrame:
    """Fill blank domains from refreshed websites; a value that is there stays."""
    fresh = websites.groupBy("business_id").agg(F.max_by("website_url", "ord").alias("_site"))
    joined = domains.join(fresh, "business_id", "left")
    value = F.coalesce(usable("domain"), F.nullif(clean_domain("_site"), F.lit("")), F.lit(""))
    return joined.withColumn("domain", value).drop("_site")


def missing_website(companies: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose website is blank; ``limit`` bounds a lookup batch."""
    rows = companies.where(usable("website_url").isNull())
    return rows if limit is None else rows.orderBy("business_id").limit(limit)


def with_employees(companies: DataFrame, employees: DataFrame) -> DataFrame:
    """Attach the employee figures of each id's last row by ``ord``."""
    one = last_row(employees, "business_id", ["employee_count", "employee_band"])
    return companies.join(one.select("business_id", "_last.*"), "business_id", "left")


def with_activity(companies: DataFrame, activity: DataFrame) -> DataFrame:
    """Attach the job activity; companies without postings get zeros."""
    columns = [c for c in activity.columns if c != "business_id"]
    joined = companies.drop(*columns).join(activity, "business_id", "left")
    fills = {c: F.coalesce(c, F.lit(False) if c == "recruiting_active" else F.lit(0)) for c in columns}
    return joined.withColumns(fills)


def score_columns(
    *,
    radius_km: float,
    allow_hit: Column,
    deny_hit: Column,
    excluded: Column,
    recruiting: Column,
    new_jobs: Column,
    tag_counts: dict[str, Column],
) -> dict[str, Column]:
    """Weighted score and its reasons from the rule weights."""
    w = rules.SCORE_WEIGHTS
    parts = [
        (F.col("distance_km") <= radius_km, "loc_ok", w["loc_ok"]),
        (allow_hit, "industry_ok", w["industry_ok"]),
        (deny_hit, "industry_blacklist", w["industry_blacklist"]),
        (excluded, "excluded", w["excluded"]),
        (recruiting, "recruiting_active", w["recruiting_active"]),
        (new_jobs > 0, "new_jobs", w["new_jobs"]),
        *[(count > 0, f"tag_{tag}", w["tag"]) for tag, count in tag_counts.items()],
    ]
    total = reduce(lambda a, b: a + b, [F.when(cond, F.lit(weight)).otherwise(F.lit(0)) for cond, _, weight in parts])
    reasons = F.concat_ws(";", *[F.when(cond, F.lit(label)) for cond, label, _ in parts])
    return {"score": total, "score_reasons": reasons}


def score_companies(
    companies: DataFrame, activity: DataFrame, *, radius_km: float, allow: list[str], deny: list[str], line: str = "main_business_line"
) -> DataFrame:
    """Join the activity, gate the industry, mark exclusions and score."""
    rows = with_activity(companies, activity).withColumns(
        {
            "_gate": industry_gate(F.col(line), allow, deny),
            "excluded_reason": exclude_reason(F.upper(F.coalesce("company_form", F.lit(""))), F.col("name")),
        }
    )
    columns = score_columns(
        radius_km=radius_km,
        allow_hit=F.col("_gate.pass") & F.startswith(F.col("_gate.reason"), F.lit("whitelist:")),
        deny_hit=F.col("_gate.hard"),
        excluded=F.col("excluded_reason").isNotNull(),
        recruiting=F.col("recruiting_active"),
        new_jobs=F.col("job_count_new_since_last"),
        tag_counts={t: F.col(f"tag_count_{t}") for t in rules.ACTIVITY_TAGS},
    )
    return rows.withColumns(columns).drop("_gate")
