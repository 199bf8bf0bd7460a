"""Event registry: rows, text rules, cross-source duplicates, daily roll-up and master table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.scalar import edit_ratio, first_match, overlap, plain_text, tokens
from hourgrid.operators.windows import latest_per_key

# Raw type -> event type.
RAW_TYPES = {
    "sport": "sport", "markt": "markt", "feest/kermis": "kermis", "andere, feest/kermis": "kermis", "feest/kermis, andere": "kermis",
    "ambulante handel": "markt", "speelstraat": "other", "terras evenement": "other", "andere": "other",
}
# Text patterns per event type and family.
FOOTBALL = r"kv\s*mechelen|malinwa|voetbal|thuiswedstrijd|achter de kazerne"
CARNIVAL = r"carnaval"
PROCESSION = r"processie|stoet|optocht"
FESTIVAL = r"festival|concert|muziek|podium|optreden"
MARKET = r"markt|braderie|rommelmarkt|jaarmarkt"
# Words that speak for and against an event, and raw types that need a word for them.
RELEVANT = (
    r"carnaval|kermis|foor|festival|concert|muziek|processie|stoet|sport|voetbal|wedstrijd|maanrock|hanswijk|malinwa|kv\s*mechelen|"
    r"braderie|jaarmarkt|rommelmarkt|optocht|koers|wedstrijd"
)
IRRELEVANT = (
    r"stadsdiensten?|verhuis|verhuizing|verhuislift|container|kraan|signalisatie|huisvuil|afval|ophaling|levering|"
    r"inname\s+openbaar\s+domein|toelating|vergunning|nutswerk|werf"
)
LOW_IMPACT = ["ambulante handel", "speelstraat", "terras evenement"]
UNNAMED = "andere"
# Base scale and attendance per event type, attendance factor per scale, confidence ranks.
SCALES = {"football": 2, "sport": 2, "festival": 2, "procession": 2, "kermis": 1, "markt": 1, "carnival": 2, "other": 1}
ATTENDANCE = {"football": 11000.0, "sport": 6000.0, "festival": 8000.0, "procession": 6000.0, "kermis": 2500.0, "markt": 1800.0, "carnival": 5000.0, "other": 1200.0}
FACTORS = {1: 0.7, 2: 1.0, 3: 1.6}
CONFIDENCE = ["verified", "estimated", "covid_modified"]
# Words that carry no name.
STOP_WORDS = ["de", "het", "een", "van", "en", "te", "op", "in", "voor", "met", "door", "aan", "straat", "plein", "mechelen", "2800", "2801", "stad", "markt"]


def _lookup(c: Column, table: dict, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), F.lit(default))


def raw_type(c: Column) -> Column:
    return _lookup(F.lower(F.trim(c)), RAW_TYPES, "other")


def drop_reason(kind: Column, text: Column, relevant: str = RELEVANT, irrelevant: str = IRRELEVANT, low_impact: Sequence[str] = LOW_IMPACT, unnamed: str = UNNAMED) -> Column:
    """Why a row is no event of interest, null where it stays.

    A word against it always counts; a type of low impact, or the type that says nothing, needs a word for it.
    """
    exact = F.lower(F.coalesce(kind, F.lit("")))
    words = F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(kind, F.lit(""))))
    silent = ~words.rlike(relevant)
    return first_match([(words.rlike(irrelevant), "irrelevant"), (exact.isin(*low_impact) & silent, "low_impact"), ((exact == unnamed) & silent, "unnamed")], F.lit(None).cast("string"))


def event_type(kind: Column, text: Column) -> Column:
    """Explicit names win over the raw type; festival only where the raw type says nothing."""
    base = raw_type(kind)
    full = F.lower(F.concat_ws(" ", kind, text))
    return first_match(
        [(full.rlike(FOOTBALL), "football"), (full.rlike(CARNIVAL), "carnival"), (full.rlike(PROCESSION), "procession"),
         ((base == "other") & full.rlike(FESTIVAL), "festival")], base)


def event_scale(kind: Column, text: Column, hours: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    base = _lookup(kind, SCALES, 1)
    return first_match([(t.contains("maanrock"), 3), (t.contains("hanswijkprocessie"), 2), (hours >= 72, F.least(F.lit(3), base + 1))], base)


def attendance(kind: Column, scale: Column) -> Column:
    return _lookup(kind, ATTENDANCE, 1200.0) * _lookup(scale, FACTORS, 1.0)


def confidence(status: Column) -> Column:
    return F.when(F.coalesce(status == "Afgelopen", F.lit(False)), "verified").otherwise("estimated")


def family(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return first_match(
        [(t.contains("maanrock"), "maanrock"), (t.contains("hanswijk"), "hanswijk"), (t.contains("carnaval"), "carnaval"),
         (t.contains("kermis") | t.contains("foor"), "kermis"), (t.rlike(FOOTBALL), "kvm"), (t.rlike(MARKET), "markt")], "other")


def standard_rows(dump: DataFrame) -> DataFrame:
    """Registry columns from a cleaned city dump (id, text, kind, status, start, hours); names are whole texts."""
    out = dump.withColumns({"event_name": F.trim(F.coalesce("text", F.lit(""))), "event_type": event_type(F.col("kind"), F.col("text")), "raw_type_norm": raw_type(F.col("kind"))})
    out = out.withColumn("event_scale", event_scale(F.col("event_type"), F.col("text"), F.col("hours")))
    return out.withColumns(
        {
            "date": F.to_date("start"), "expected_attendance": attendance(F.col("event_type"), F.col("event_scale")),
            "football_kickoff_hour": F.when(F.col("event_type") == "football", F.hour("start") + F.minute("start") / 60),
            "data_confidence": confidence(F.col("status")), "is_multiday_event": (F.col("hours") >= 24).cast("tinyint"),
            "event_family": family(F.col("event_name")), "type_mismatch": F.col("raw_type_norm") != F.col("event_type"),
        }
    )


def clean_dump(df: DataFrame, owners: Sequence[str], statuses: Sequence[str], blocked: str, zone: str = "Europe/Brussels") -> DataFrame:
    """Owner, status and blocked-word filters, local times, duration not negative, latest end per id."""
    out = df.where(F.col("owner").isin(list(owners)) & F.col("status").isin(list(statuses)) & ~F.coalesce(F.lower("text").rlike(blocked), F.lit(False)))
    out = out.withColumns({"start_local": F.from_utc_timestamp("start", zone), "end_local": F.from_utc_timestamp("finish", zone)})
    out = out.withColumn("hours", (F.unix_timestamp("finish") - F.unix_timestamp("start")) / 3600).where("hours >= 0")
    return latest_per_key(out, ["id"], [F.col("finish"), F.col("start"), F.col("text")])


def records(config: DataFrame) -> DataFrame:
    """Event rows for dates and date ranges: (start, end, attributes) to one row per day."""
    days = F.sequence(F.col("start"), F.coalesce("end", "start"))
    out = config.withColumn("date", F.explode(days))
    return out.withColumn("is_multiday_event", (F.coalesce("end", "start") > F.col("start")).cast("tinyint")).drop("start", "end")


def registry_checks(df: DataFrame, label: str, required: Sequence[str] = ("date", "name", "kind")) -> DataFrame:
    """Missing columns, null dates and duplicates by (date, kind, name)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{label}: missing columns {missing}")
    per = df.groupBy("date", "kind", "name").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("date").isNull(), F.col("n"))), F.lit(0)).alias("n_null_dates"),
                   F.sum(F.col("n") - 1).alias("n_duplicates")).withColumn("registry", F.lit(label))


def daily_events(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Roll-up per day from (date, name, kind, scale, kickoff_hour, confidence, id).

    Distinct kinds and names are reduced in a first step, so a day with very many rows never builds a large set.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence"))
    first = F.min_by("kickoff_hour", F.when(F.col("kickoff_hour").isNotNull(), F.col("id")))
    first_id = F.min(F.when(F.col("kickoff_hour").isNotNull(), F.col("id")))
    per = df.groupBy("date", "kind", "name").agg(
        F.max("scale").alias("s"), F.max(rank).alias("c"), first.alias("k"), first_id.alias("ki"), F.count("*").alias("n"))
    aggs = [
        F.max("s").alias("event_scale_max"), F.size(F.collect_set("kind")).alias("n_concurrent_events"), F.min_by("k", "ki").alias("football_kickoff_hour"),
        F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.max("c").cast("int")).alias("data_confidence"),
        F.array_join(F.array_sort(F.collect_set("name")), " | ").alias("event_names_combined"),
    ]
    aggs += [F.max((F.col("kind") == kind).cast("int")).alias(flag) for flag, kind in flags.items()]
    return per.groupBy("date").agg(*aggs).withColumn("is_event_day", F.lit(1))


def events_master(daily: DataFrame, spine: DataFrame, flags: Sequence[str]) -> DataFrame:
    """One row per spine day; days without events get defaults."""
    out = spine.join(daily, "date", "left")
    zero = {c: 0 for c in ["event_scale_max", "n_concurrent_events", "is_event_day", *flags]}
    return out.fillna({**zero, "data_confidence": "verified", "event_names_combined": ""})


def master_checks(master: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Structure of the master table: unique dates, no gaps, 0/1 flags, no nulls."""
    bad_flag = F.lit(False)
    for c in flags:
        bad_flag = bad_flag | F.col(c).isNull() | ~F.col(c).isin(0, 1)
    s = master.groupBy("date").agg(F.count("*").alias("n"), F.max(bad_flag.cast("int")).alias("b"), F.max(F.col("data_confidence").isNull().cast("int")).alias("u"))
    s = s.agg(F.sum(F.col("n") - 1).alias("dup"), (F.datediff(F.max("date"), F.min("date")) + 1 - F.count("*")).alias("gap"), F.sum("b").alias("bad"), F.sum("u").alias("nul"))
    names = {"dup": "unique_dates", "gap": "no_missing_days", "bad": "flags_are_0_1", "nul": "no_null_confidence"}
    arms = [F.struct(F.lit(v).alias("check"), F.when(F.col(k) == 0, "PASS").otherwise("FAIL").alias("result"), F.col(k).cast("bigint").alias("n")) for k, v in names.items()]
    return s.select(F.inline(F.array(*arms)))


def _grams(text: Column, size: int = 3) -> Column:
    """All distinct character triples; a shorter text is its own single gram."""
    span = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(span, lambda i: F.substr(text, i, F.lit(size))))


def cross_source_duplicates(rows: DataFrame, baseline: DataFrame, min_ratio: float = 0.90, min_overlap: float = 0.60) -> DataFrame:
    """Which rows repeat a baseline event of the same date: same family, contained name, or similar name and tokens.

    ``rows`` has (id, date, name), ``baseline`` (date, name). Names are reduced to distinct (date, name) before any
    comparison, so copies of one name cost once. A family match needs no pairs at all. Candidate pairs for the name
    tests come from equality joins that cannot miss a match: a contained name shares its first triple, a similar name
    with enough common tokens shares a token.
    """
    def prepare(df: DataFrame) -> DataFrame:
        names = df.select("date", "name").distinct()
        plain = names.withColumn("plain", plain_text("name"))
        return plain.withColumns({"words": tokens(F.col("plain"), STOP_WORDS), "fam": family(F.col("name"))})

    a, b = prepare(rows), prepare(baseline)
    fam = a.where("fam <> 'other'").join(b.select("date", "fam").distinct(), ["date", "fam"], "left_semi").select("date", "name").withColumn("family_match", F.lit(True))
    # Plain names once more made distinct: different spellings often share one plain form.
    pa = a.select("date", "plain", "words").distinct().where("plain <> ''")
    pb = b.select("date", F.col("plain").alias("other"), F.col("words").alias("other_words")).distinct()
    # A name shorter than a triple is matched on its first character.
    def anchor(c: Column, size: int) -> Column:
        return F.substring(c, 1, size)

    contained = []
    for size in (3, 1):
        short_a = (F.length("plain") >= 3) if size == 3 else (F.length("plain") < 3)
        short_b = (F.length("other") >= 3) if size == 3 else (F.length("other") < 3)
        inner = pa.where(short_a).withColumn("g", anchor(F.col("plain"), size))
        outer = pb.withColumn("g", F.explode(_grams(F.col("other"), size)))
        contained.append(inner.join(outer, ["date", "g"]).where(F.col("other").contains(F.col("plain"))).select("date", "plain"))
        inner = pb.where(short_b & (F.col("other") != "")).withColumn("g", anchor(F.col("other"), size))
        outer = pa.withColumn("g", F.explode(_grams(F.col("plain"), size)))
        contained.append(inner.join(outer, ["date", "g"]).where(F.col("plain").contains(F.col("other"))).select("date", "plain"))
    # An empty baseline name is contained in every name of its date.
    contained.append(pa.join(pb.where("other = ''").select("date").distinct(), "date", "left_semi").select("date", "plain"))
    exact = contained[0]
    for c in contained[1:]:
        exact = exact.unionByName(c)
    exact = exact.distinct().withColumn("exact_match", F.lit(True))
    # The smaller of two token lists shares at least a part of its tokens, so one of its rarest ones is among the shared:
    # only those are joined, and a frequent token meets nothing unless a name has no rarer one.
    every = pa.select(F.explode("words").alias("w")).unionByName(pb.select(F.explode("other_words").alias("w")))
    often = every.groupBy("w").agg(F.count("*").alias("often"))

    def rarest(names: DataFrame, words: str) -> DataFrame:
        long = names.withColumn("w", F.explode(words)).join(often, "w")
        sets = long.groupBy(*names.columns).agg(F.array_sort(F.collect_list(F.struct("often", "w"))).alias("_s"))  # the tokens of one name
        spare = F.size("_s") - F.ceil(F.size("_s") * F.lit(min_overlap) - 1e-9).cast("int") + 1
        return sets.select(*names.columns, F.explode(F.slice("_s", F.lit(1), F.greatest(F.least(spare, F.size("_s")), F.lit(1))).getField("w")).alias("w"))

    near_length = F.least(F.length("plain"), F.length("other")) >= min_ratio * F.greatest(F.length("plain"), F.length("other"))
    named_b = pb.select("date", "other", "other_words")
    by_a = rarest(pa, "words").join(named_b.withColumn("w", F.explode("other_words")), ["date", "w"]).where(F.size("words") <= F.size("other_words"))
    by_b = rarest(named_b, "other_words").join(pa.withColumn("w", F.explode("words")), ["date", "w"]).where(F.size("words") > F.size("other_words"))
    pairs = by_a.where(near_length).select("date", "plain", "words", "other", "other_words").unionByName(by_b.where(near_length).select("date", "plain", "words", "other", "other_words")).distinct()
    close = (edit_ratio(F.col("plain"), F.col("other")) >= min_ratio) & (overlap(F.col("words"), F.col("other_words")) >= min_overlap)
    similar = pairs.where(close).select("date", "plain").distinct().withColumn("similar_match", F.lit(True))
    marks = a.select("date", "name", "plain").join(fam, ["date", "name"], "left").join(exact, ["date", "plain"], "left").join(similar, ["date", "plain"], "left")
    marks = marks.select("date", "name", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("family_match", "exact_match", "similar_match")])
    out = rows.join(marks, ["date", "name"], "left")
    return out.withColumn("is_probable_duplicate", F.col("family_match") | F.col("exact_match") | F.col("similar_match"))


def integrate(baseline: DataFrame, extra: DataFrame, keys: Sequence[str] = ("date", "kind", "name")) -> DataFrame:
    """Both sources, one row per key, the lower source_priority first."""
    both = baseline.unionByName(extra, allowMissingColumns=True)
    return latest_per_key(both, list(keys), [F.col("source_priority"), F.col("id")], earliest=True)


def summaries(master: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Days and share per flag, from one aggregation."""
    n = F.count("*")
    arms = [F.struct(F.lit(c).alias("flag"), F.sum(F.col(c)).alias("n_days"), (F.sum(F.col(c)) / n * 100).alias("pct_days")) for c in flags]
    return master.agg(F.array(*arms).alias("a")).select(F.inline("a"))
