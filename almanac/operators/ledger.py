"""Ledgers of disclosed events: typed facts, revision chains, matches with a vendor's rows, and evidence in the pages of a document."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The patterns of disclosure templates (a year comes before the first two), their section marks, qualifying words, and tolerances.
PERIOD, NUMBER = r"年1[-—－至]3月归属于上市公司股东的净利润", r"([+-]?\d+(?:\.\d+)?)"
EARLIER, LATER, DATE = "前次业绩预告情况", "修正后的预计|修正后预计|3、|3[.]|3．", r"(20\d\d)年(\d{1,2})月(\d{1,2})日"
APPROXIMATE, LOSS, NO_LOSS, DECLINE, NO_DECLINE, PERCENT = "约|左右", "亏损", "盈利|扭亏", "下降", "增长|上升|亏损", "[%％]"
PAGE, TOLERANCE = "=== PAGE ", "0.011"
#: Money units and their scale in yuan, and which of lower, upper and point each kind of value has.
SCALES = {"元": 1, "千元": 1_000, "万元": 10_000, "百万元": 1_000_000, "亿元": 100_000_000}
KINDS = {"RANGE": "110", "POINT": "001", "APPROX_POINT": "001", "OPEN_LOWER": "100", "OPEN_UPPER": "010", "MISSING": "000"}


def written(x: Column) -> Column:
    """A number as Python writes a float (between 0.0001 and 1e16 in size), None for null: what serials within a date are ordered by."""
    plain = F.regexp_replace(x.cast("double").cast("string").cast("decimal(38,12)").cast("string"), "0+$", "")
    return F.coalesce(F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain), F.lit("None"))


def merge_typed(records: DataFrame, keys: list[str], values: list[str], ident: str, status: str = "data_status") -> DataFrame:
    """One event per key and equal values: its idents in order, a serial within the key, and its status.

    Serials follow the order of the values' text, so 10.0 comes before 9.0. A key with different values is quarantined whole; otherwise
    an event of any quarantined record keeps the first such status by name, and else the status of its first record.
    """
    merged = records.groupBy(*keys, *values).agg(F.sort_array(F.collect_list(ident)).alias("ids"), F.min(F.when(F.col(status).startswith("QUARANTINED"), F.col(status))).alias("_bad"), F.min_by(status, ident).alias("_first"))
    key = W.partitionBy(*keys)
    several = F.count("*").over(key) > 1
    serial = F.row_number().over(key.orderBy(F.concat_ws(", ", *(written(F.col(v)) for v in values))))
    out = merged.withColumn("serial", serial).withColumn("same_date_conflict", several)
    return out.withColumn(status, F.when(F.col("same_date_conflict"), "QUARANTINED_SAME_DATE_VALUES").otherwise(F.coalesce("_bad", "_first"))).drop("_bad", "_first")


def broken_chains(events: DataFrame, chain: str, event: str, available: str, supersedes: str, status: str = "data_status") -> DataFrame:
    """(chain, reason): chains with a quarantined event, or one whose predecessor is not the event that it says it supersedes."""
    w = W.partitionBy(chain).orderBy(F.col(available).asc_nulls_last(), event)
    x = events.withColumn("_before", F.lag(event).over(w))
    reason = F.when(F.col(status).startswith("QUARANTINED"), "quarantined_chain").when(F.col("_before").isNotNull() & ~F.col(supersedes).eqNullSafe(F.col("_before")), "unverified_predecessor")
    return x.select(chain, reason.alias("reason")).where("reason is not null").groupBy(chain).agg(F.min("reason").alias("reason"))


def chain_asof(signals: DataFrame, events: DataFrame, chain: str, on: str, event: str, available: str, supersedes: str, status: str = "data_status") -> DataFrame:
    """signals (chain, on) with the event known on their date, its first available date included; null before, and for chains that are broken."""
    from almanac.operators.asof import asof

    sound = events.join(broken_chains(events, chain, event, available, supersedes, status).select(chain), chain, "left_anti").where(F.col(available).isNotNull())
    return asof(signals, sound.select(chain, available, event), chain, on, available, [event], strict=False).drop("at")


def chain_summary(documents: DataFrame, keys: list[str], ident: str, noticed: str, revision: str, references: str) -> DataFrame:
    """(keys, documents, revisions, ids, notice_dates, missing_references): a key's documents, and the earlier dates they refer to that none of them has."""
    g = documents.groupBy(*keys).agg(F.count("*").alias("documents"), F.count_if(revision).alias("revisions"), F.sort_array(F.collect_list(F.struct(noticed, ident))).alias("_d"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(references)))).alias("_r"))
    return g.select(*keys, "documents", "revisions", F.col(f"_d.{ident}").alias("ids"), F.col(f"_d.{noticed}").alias("notice_dates"), F.array_except("_r", F.col(f"_d.{noticed}")).alias("missing_references"))


def compare_growth(status: Column, kind: Column, lower: Column, upper: Column, point: Column, vendor_lower: Column, vendor_upper: Column) -> Column:
    """A struct (status, difference): a vendor's growth bounds, as text, against the primary ones, in exact decimals and percentage points."""
    number = lambda c: F.when(F.trim(c) != "", c).try_cast("decimal(30,10)")
    blank = lambda c: c.isNull() | (c == "")
    lo, hi = F.least(number(vendor_lower), number(vendor_upper)), F.greatest(number(vendor_lower), number(vendor_upper))
    exact = lambda c: c.cast("decimal(30,10)")
    a, b = F.when(kind == "RANGE", exact(lower)).otherwise(exact(point)), F.when(kind == "RANGE", exact(upper)).otherwise(exact(point))
    gap = F.greatest(F.abs(lo - a), F.abs(hi - b))
    comparable = (kind == "RANGE") | ((kind == "POINT") & (lo == hi))
    verdict = (
        F.when(status.startswith("QUARANTINED"), "QUARANTINED_PRIMARY")
        .when(blank(vendor_lower) | blank(vendor_upper), "MISSING_VENDOR_BOUND")
        .when(number(vendor_lower).isNull() | number(vendor_upper).isNull(), "INVALID_VENDOR_NUMBER")
        .when(~F.coalesce(comparable, F.lit(False)), "NOT_COMPARABLE_VALUE_KIND")
        .when(gap <= F.lit(TOLERANCE).cast("decimal(30,10)"), "AGREES_WITHIN_0_011_PP")
        .otherwise("SOURCE_DIFFERENCE")
    )
    return F.struct(verdict.alias("status"), F.when(verdict.isin("AGREES_WITHIN_0_011_PP", "SOURCE_DIFFERENCE"), gap.cast("double")).alias("difference"))


def match_events(vendor: DataFrame, events: DataFrame, keys: list[str], event: str, documents: DataFrame | None = None, document_keys: list[str] | None = None, status: str = "data_status") -> DataFrame:
    """vendor rows with matched (the events of their key, in order) and match_status.

    One sound event is a match, several or a quarantined one a conflict; without any, a document of the same date makes the row pending.
    """
    e = events.groupBy(*keys).agg(F.sort_array(F.collect_list(event)).alias("matched"), F.max(F.col(status).startswith("QUARANTINED")).alias("_bad"))
    x = vendor.join(e, keys, "left")
    there = F.lit(False)
    if documents is not None:
        x = x.join(documents.select(*document_keys, F.lit(True).alias("_doc")).distinct(), document_keys, "left")
        there = F.col("_doc").isNotNull()
    n = F.coalesce(F.size("matched"), F.lit(0))
    verdict = F.when((n > 1) | F.coalesce("_bad", F.lit(False)), "PRIMARY_CONFLICT_QUARANTINE").when(n == 1, "MATCHED_REVIEWED_PRIMARY_EVENT").when(there, "PRIMARY_CONTENT_PENDING").otherwise("NO_SAME_DATE_PRIMARY_IN_ARCHIVE")
    return x.withColumn("match_status", verdict).withColumn("matched", F.coalesce("matched", F.array().cast(e.schema["matched"].dataType))).drop("_bad", "_doc")


def vendor_scope(period: Column, notice: Column, targets: list[str], member: Column) -> Column:
    """Why a vendor's row is out of scope, in order; empty if it is within. Dates are text; a target's notices lie between its year's first day and the end of April."""
    year = F.substring(period, 1, 4)
    known = F.coalesce(period.isin(*targets), F.lit(False))
    dated = notice.try_cast("date").isNotNull()
    inside = notice.between(F.concat(year, F.lit("-01-01")), F.concat(year, F.lit("-04-30")))
    return F.array_compact(F.array(F.when(~known, "NON_TARGET_REPORT_PERIOD"), F.when(~dated, "INVALID_PUBLICATION_DATE"), F.when(dated & known & ~inside, "OUTSIDE_TARGET_NOTICE_WINDOW"), F.when(~F.coalesce(member, F.lit(False)), "NOT_IN_TARGET_YEAR_MEMBER_UNION")))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, however often `then` uses it: as a column it would be worked out again at each use."""
    return F.transform(F.array(value), then)[0]


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def pages(text: Column) -> Column:
    """The pages of a text with marks === PAGE n ===, as a map from their numbers; of a repeated number the last page."""
    parts = let(F.split(text, r"=== PAGE (?=\d+ ===)"), lambda p: F.slice(p, F.lit(2), F.greatest(F.lit(0), F.size(p) - 1)))
    entry = lambda p: F.struct(F.regexp_extract(p, r"^(\d+) ===", 1).cast("int").alias("n"), F.regexp_replace(p, r"^\d+ ===", "").alias("text"))
    last = lambda rows: F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda s: s["n"] == r["n"]))
    return F.map_from_entries(let(F.transform(parts, entry), last))


def numbers(quote: Column) -> Column:
    """The distinct magnitudes in a quote as decimals. Thousands marks are taken out of grouped digits; blanks between digits stay a boundary."""
    s = F.translate(quote, "，−－", ",--")
    s = F.regexp_replace(s, r"(?<=\d),(?=\d{3}(?!\d))", "")
    found = F.regexp_extract_all(s, F.lit(r"(?<![\d.])[+-]?(\d+(?:\.\d+)?)(?![\d.])"), 1)
    return F.array_distinct(F.transform(found, lambda x: x.cast("decimal(30,8)")))


def only_match(text: Column, pattern: str, groups: int = 1) -> Column:
    """The groups of a pattern as an array, where all its matches are equal; null without a match and with different ones."""
    each = [F.regexp_extract_all(text, F.lit(pattern), i + 1) for i in range(groups)]
    rows = F.array_distinct(F.arrays_zip(*(e.alias(f"g{i}") for i, e in enumerate(each))))
    return F.when(F.size(rows) == 1, F.array(*(rows[0][f"g{i}"] for i in range(groups))))


def first_quarter_guidance(text: Column, year: int) -> Column:
    """A struct (profit_lower, profit_upper, growth_lower, growth_upper) of a template's lines on the parent's net profit, in yuan and percent; null unless both lines have one value each.

    Blanks between two numbers become a boundary before the others go, so a bound is never joined with a following year.
    """
    s = F.regexp_replace(text, r"(?<=[\d.])\s+(?=[+\-\d.])", "|")
    s = F.translate(compact(s), "−,，", "-")
    period = f"{year}{PERIOD}"
    money = F.transform(only_match(s, rf"{period}区间[（(]万元[）)]{NUMBER}至{NUMBER}", 2), lambda x: x.cast("decimal(30,8)") * 10_000)
    growth = F.transform(only_match(s, rf"{period}变动幅度{NUMBER}{PERCENT}至{NUMBER}{PERCENT}", 2), lambda x: x.cast("double"))
    both = money.isNotNull() & growth.isNotNull()
    return F.when(both, F.struct(F.array_min(money).cast("double").alias("profit_lower"), F.array_max(money).cast("double").alias("profit_upper"), F.array_min(growth).alias("growth_lower"), F.array_max(growth).alias("growth_upper")))


def referred_dates(text: Column) -> Column:
    """Dates in the section on an earlier forecast, in order, up to where the next section begins; empty without that section."""
    after = F.get(F.split(compact(text), EARLIER, 2), F.lit(1))
    section = F.element_at(F.split(after, LATER, 2), 1)
    parts = [F.regexp_extract_all(section, F.lit(DATE), i) for i in (1, 2, 3)]
    pad = lambda x: F.lpad(x, 2, "0")
    dates = F.transform(F.arrays_zip(parts[0].alias("y"), parts[1].alias("m"), parts[2].alias("d")), lambda r: F.concat_ws("-", r["y"], pad(r["m"]), pad(r["d"])))
    return F.coalesce(F.array_sort(F.array_distinct(dates)), F.array().cast("array<string>"))


def evidence_errors(doc: str = "doc", text: str = "text") -> Column:
    """The error codes of a transcribed record against its document, sorted and distinct; empty if the evidence holds.

    The row has a struct `record` (announcement_id, claim_type, document_class, extraction_status, money_unit, period, signature_date, prior_reference,
    profit and yoy: structs (kind, lower, upper, point), evidence: array of (field, page, quote)), a struct `doc` (announcement_id, period) and the
    document's text with page marks. Every number must stand in a quote of its field that its page has, in the record's unit.
    """

    def item(page: Column, e: Column) -> Column:
        """One piece of evidence: its field and quote, the quote compact, whether it has words, whether its page is there, and whether that page has it."""
        held = lambda q: F.coalesce(compact(page[e["page"]]).contains(q), F.lit(False))
        return let(compact(e["quote"]), lambda q: F.struct(e["field"].alias("field"), e["page"].alias("page"), e["quote"].alias("quote"), F.coalesce(F.length(q) > 0, F.lit(False)).alias("full"), F.coalesce(F.map_contains_key(page, e["page"]), F.lit(False)).alias("there"), held(q).alias("inside")))

    def support(items: Column) -> Column:
        """The quotes of each field that stand in their pages, and without blanks as one text, and what is wrong with other evidence."""
        quotes = lambda field: F.transform(F.filter(items, lambda e: e["full"] & e["there"] & (e["field"] == field) & e["inside"]), lambda e: e["quote"])
        fault = lambda e: F.when(~e["full"], F.concat(F.lit("EMPTY_QUOTE:"), e["field"])).when(~e["there"], F.concat(F.lit("MISSING_PAGE:"), F.coalesce(e["page"].cast("string"), F.lit("None")))).when(~e["inside"], F.concat(F.lit("QUOTE_NOT_IN_PAGE:"), e["field"]))
        own = lambda field: let(quotes(field), lambda q: F.struct(q.alias("quotes"), compact(F.array_join(q, "")).alias("joined"))).alias(field)
        return F.struct(*map(own, ("signature_date", "prior_reference", "parent_profit_range", "yoy_range")), F.transform(items, fault).alias("bad"))

    found = let(pages(F.col(text)), lambda page: F.transform(F.col("record.evidence"), lambda e: item(page, e)))
    return let(F.struct(F.col("record").alias("record"), F.col(doc).alias("doc"), let(found, support).alias("held")), lambda row: _evidence_codes(row["record"], row["doc"], row["held"]))


def _evidence_codes(record: Column, doc: Column, held: Column) -> Column:
    """The codes of a record with what supports it: by field a struct (quotes, joined), and `bad`."""
    r = lambda c: reduce(lambda a, b: a[b], c.split("."), record)
    quotes, joined = (lambda field: held[field]["quotes"]), (lambda field: held[field]["joined"])
    bounds = ("lower", "upper", "point")
    value = lambda p, b: r(f"{p}.{b}")
    some = reduce(lambda a, b: a | b, (value(p, b).isNotNull() for p in ("profit", "yoy") for b in bounds))
    scale = F.element_at(F.create_map(*(F.lit(x) for kv in SCALES.items() for x in kv)), F.coalesce(r("money_unit"), F.lit("")))
    codes = [
        F.when(~r("announcement_id").eqNullSafe(doc["announcement_id"]), "IDENTITY_MISMATCH"),
        F.when(~r("claim_type").eqNullSafe(F.lit("source_claim")), "CLAIM_TYPE_MUST_BE_SOURCE_CLAIM"),
        F.when(~F.coalesce(r("document_class").isin("Q1_FORECAST", "Q1_EXPRESS", "ANNUAL_ONLY", "OTHER", "UNRESOLVED"), F.lit(False)), "INVALID_DOCUMENT_CLASS"),
        F.when(~F.coalesce(r("extraction_status").isin("DRAFT_EXTRACTED", "NEEDS_REVIEW"), F.lit(False)), "INVALID_EXTRACTION_STATUS"),
        F.when(r("money_unit").isNotNull() & ~r("money_unit").isin(*SCALES, "mixed"), "INVALID_MONEY_UNIT"),
        F.when(some & ~F.coalesce(r("document_class").isin("Q1_FORECAST", "Q1_EXPRESS"), F.lit(False)), "NUMERIC_WITHOUT_VERIFIED_Q1_PERIOD"),
        F.when(r("period") != doc["period"], "PERIOD_DIFFERS_FROM_QUERY_TARGET_REVIEW_REQUIRED"),
        F.when(r("signature_date").isNotNull() & (F.size(quotes("signature_date")) == 0), "SIGNATURE_DATE_EVIDENCE_MISSING"),
        F.when(r("prior_reference").isNotNull() & (F.size(quotes("prior_reference")) == 0), "PRIOR_REFERENCE_EVIDENCE_MISSING"),
    ]
    for p, field in (("profit", "parent_profit_range"), ("yoy", "yoy_range")):
        present = F.concat(*(F.when(value(p, b).isNull(), "0").otherwise("1") for b in bounds))
        wanted = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.coalesce(r(f"{p}.kind"), F.lit("")))
        codes += [F.when(value(p, "lower") > value(p, "upper"), f"UNORDERED_RANGE:{p}"), F.when(~wanted.eqNullSafe(present), f"VALUE_KIND_CONFLICT:{p}")]
        codes.append(F.when((r(f"{p}.kind") == "APPROX_POINT") & ~joined(field).rlike(APPROXIMATE), f"APPROX_POINT_QUALIFIER_MISSING:{p}"))
        for b in bounds:
            v, name = value(p, b), f"{p}.{b}"
            quoted = F.size(quotes(field)) > 0
            unit = F.when(scale.isNull(), f"UNRESOLVED_CURRENCY_SCALE:{name}").when(~joined(field).contains(r("money_unit")), f"UNIT_NOT_IN_QUOTE:{name}") if p == "profit" else F.when(~joined(field).rlike(PERCENT), f"PERCENT_UNIT_NOT_IN_QUOTE:{name}")
            number = F.abs(v.cast("decimal(30,8)")) / (scale if p == "profit" else F.lit(1))
            stands = let(number, lambda n: F.exists(quotes(field), lambda q: F.exists(numbers(q), lambda x: x == n)))  # noqa: B023
            codes += [F.when(v.isNotNull() & ~quoted, f"MISSING_SUPPORT:{name}"), F.when(v.isNotNull() & quoted, unit)]
            codes.append(F.when(v.isNotNull() & quoted & (scale.isNotNull() if p == "profit" else F.lit(True)) & ~F.coalesce(stands, F.lit(False)), f"UNSUPPORTED_NUMBER:{name}"))
    money, growth = joined("parent_profit_range"), joined("yoy_range")
    above = lambda p: reduce(lambda a, b: a | b, (F.coalesce(value(p, b) > 0, F.lit(False)) for b in bounds))
    codes.append(F.when(money.contains(LOSS) & ~money.rlike(NO_LOSS) & above("profit"), "LOSS_SIGN_CONFLICT"))
    codes.append(F.when(growth.contains(DECLINE) & ~growth.rlike(NO_DECLINE) & above("yoy"), "DECLINE_SIGN_CONFLICT"))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*codes), F.coalesce(held["bad"], F.array().cast("array<string>"))))))


def retrieve(documents: DataFrame, text: Column, ident: str, query: str, limit: int = 10) -> DataFrame:
    """documents with relevance, the number of distinct words of the query that they have; the best `limit`, ties by ident. An empty query finds all.

    Words are runs of letters, digits and underscores in lower case.
    """
    if len(query) > 2000 or type(limit) is not int or not 1 <= limit <= 50:
        raise ValueError("a query has 2,000 characters at most, a limit is 1 to 50")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    asked = words(F.lit(query))
    scored = documents.withColumn("relevance", F.size(F.array_intersect(words(F.coalesce(text, F.lit(""))), asked)))
    return scored.where((F.size(asked) == 0) | (F.col("relevance") > 0)).orderBy(F.desc("relevance"), ident).limit(limit)
