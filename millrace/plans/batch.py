"""The pipelines: text reports, histograms, cleansing, aggregates, group statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numbers, text, times
from millrace.operators import rows, series

#: What ends a line for universal newlines, and for Python's splitlines().
UNIVERSAL = r"\r\n|\r|\n"
SPLITLINES = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
#: So many groups' lengths at most are broadcast.
BROADCAST_ROWS = 1_000_000


def lines_of(df: DataFrame, column: str, keep: Sequence[str] = (), ends: str = UNIVERSAL) -> DataFrame:
    """A row (keep, line_no from 1, line) for each line; what follows a final line end is no line."""
    parts = F.split(F.regexp_replace(column, f"(?:{ends})\\z", ""), ends)
    return df.filter(F.length(column) > 0).select(*keep, F.posexplode(parts)).select(*keep, (F.col("pos") + 1).cast("long").alias("line_no"), F.col("col").alias("line"))


def longest_lines(lines: DataFrame, by: Sequence[str] = (), line: str = "line") -> DataFrame:
    """All lines of the greatest length (in code points), over all lines or those of each group."""
    sized = lines.withColumn("line_length", F.length(line).cast("long"))
    best = sized.groupBy(*by).agg(F.max("line_length").alias("line_length"))
    return sized.join(best if by else F.broadcast(best), [*by, "line_length"], "left_semi")


def longest_lines_of(df: DataFrame, column: str, keep: Sequence[str] = (), by: Sequence[str] = (), ends: str = UNIVERSAL) -> DataFrame:
    """(keep, line_no, line, line_length): the longest lines of the texts of a column, over all or those of each group. by is part of keep.

    A text is split once for its longest line; only texts that are as long as the longest line of their group are split again.
    """
    texts = df.filter(F.length(column) > 0)
    size = F.array_max(F.transform(F.split(column, ends), F.length)).cast("long")
    best = texts.groupBy(*by).agg(F.max(size).alias("line_length"))
    if by:
        long = texts.join(F.broadcast(best) if best.count() <= BROADCAST_ROWS else best, list(by))
    else:
        # one row, which is empty over an empty table
        long = texts.crossJoin(F.broadcast(best))
    found = lines_of(long.filter(F.length(column) >= F.col("line_length")), column, [*keep, "line_length"], ends)
    return found.filter(F.length("line") == F.col("line_length")).select(*keep, "line_no", "line", "line_length")


def longest_reports(objects: DataFrame, name: str, value: str, numbered: bool = True, prefix: str = "", least: int = 0) -> DataFrame:
    """(name, position, value): the lines of each object's report, in order of position; objects (name, value) are named once each.

    numbered: a head with the source (after prefix), the length and the number of longest lines, an empty line, then each longest line
    with its number and length. Else a shorter head with the name's last part, then the lines alone, where lines end as
    str.splitlines() has it. An object without lines has the length `least` and no lines.
    """
    own = objects.select(F.col(name).alias("name"), F.coalesce(F.col(value), F.lit("")).alias("value"))
    found = longest_lines_of(own, "value", ["name"], ["name"], UNIVERSAL if numbered else SPLITLINES)
    head = own.select("name").join(found.groupBy("name").agg(F.max("line_length").alias("n"), F.count("*").alias("k")), "name", "left")
    n, k = F.coalesce("n", F.lit(least)).cast("string"), F.coalesce("k", F.lit(0)).cast("string")
    if numbered:
        top = [F.concat(F.lit(f"Source: {prefix}"), "name"), F.concat(F.lit("Max length (characters, excluding newline): "), n), F.concat(F.lit("Number of longest lines: "), k), F.lit(""), F.lit("Longest line(s):")]
        line = F.format_string("[Line %d] (%d chars): %s", "line_no", "line_length", "line")
    else:
        top = [F.concat(F.lit("Input file: "), F.substring_index("name", "/", -1)), F.concat(F.lit("Maximum line length: "), n), F.lit("Longest line(s):")]
        line = F.col("line")
    heads = head.select("name", F.posexplode(F.array(*top)).alias("position", "value")).withColumn("position", (F.col("position") - len(top)).cast("long"))
    return heads.unionByName(found.select("name", F.col("line_no").alias("position"), line.alias("value")))


def write_reports(reports: DataFrame, path: str) -> None:
    """Each report as one text file in a folder path/report=<its name>; reports are (name, position, value). A report is as long as
    its object's longest lines, and is written by one task."""
    out = reports.repartition("name").sortWithinPartitions("name", "position")
    out.select(F.col("name").alias("report"), "value").write.mode("overwrite").partitionBy("report").text(path)


def clicks_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(user_id, ts, hour) of raw lines `user,time`: what has no comma, no time or is the header goes, and what has no hour; an hour may have one
    digit and need not be one of a day. ts is null where the time isn't one."""
    parts = F.split(column, ",", 2)
    ts = F.trim(parts[1])
    hour = F.split_part(F.split_part(ts, F.lit(" "), F.lit(2)), F.lit(":"), F.lit(1)).try_cast("int")
    out = lines.filter(F.size(parts) == 2).select(parts[0].alias("user_id"), ts.alias("raw"), hour.alias("hour"))
    out = out.filter(~F.lower("raw").startswith("timestamp") & F.col("hour").isNotNull())
    return out.select("user_id", times.parse_time(F.col("raw"), "yyyy-MM-dd H:mm:ss").alias("ts"), "hour")


def timetable_stats(raw: DataFrame, key: str = "Station Name", arrival: str = "Arrival Time", departure: str = "Departure Time", wrap_midnight: bool = False) -> DataFrame:
    """group_stats() of the minutes between arrival and departure of a raw timetable (all text). Rows with a null in any column go; a
    time that isn't HH:mm:ss has no duration."""
    whole = raw.na.drop()
    own = whole.select(key, times.minutes_apart(times.parse_time(F.col(arrival), "HH:mm:ss"), times.parse_time(F.col(departure), "HH:mm:ss"), wrap_midnight).alias("duration"))
    return group_stats(own, key, "duration")


def time_of_day_histogram(df: DataFrame, ts: str, keep_unknown: bool = False, hour: str | None = None) -> DataFrame:
    """(bin, click_count) with all four bins, also empty ones; with keep_unknown also what has no hour, if there is any. hour names a
    column to take in place of the hour of ts."""
    counts = df.select(times.hour_bin(F.col(hour) if hour else F.hour(ts)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("click_count"))
    bins = df.sparkSession.createDataFrame([(f"{a}-{b}",) for a, b in times.BINS], "bin string")
    if keep_unknown:
        return counts.unionByName(bins.withColumn("click_count", F.lit(0).cast("long"))).groupBy("bin").agg(F.sum("click_count").alias("click_count"))
    # the counts are five rows at most, however many rows were counted
    return bins.join(counts, "bin", "left").na.fill(0, ["click_count"])


def in_day_order(histogram: DataFrame) -> DataFrame:
    """The bins with their place in the day (ordinal from 0, unknown last), sorted by it."""
    place = F.lit(len(times.BINS))
    for i, (a, b) in enumerate(times.BINS):
        place = F.when(F.col("bin") == f"{a}-{b}", i).otherwise(place)
    return histogram.withColumn("ordinal", place).orderBy("ordinal")


@dataclass
class Cleansed:
    customers: DataFrame
    transactions: DataFrame
    invalid_customers: DataFrame
    invalid_transactions: DataFrame


def cleanse(customers: DataFrame, transactions: DataFrame, low: float = 2500.0, high: float = 7500.0, reasons: bool = False, cut: Callable[[DataFrame], DataFrame] | None = None) -> Cleansed:
    """Type, enrich, de-duplicate, validate and check references; what fails is in the quarantine frames.

    Customers need customer_id, city, status; transactions transaction_id, customer_id, a positive transaction_amount and
    a transaction_date. The raw amount is kept in transaction_amount_orig and counts when rows are compared. Without a city column
    customers are checked for the other two. With reasons the quarantine has a column reason. cut (materialise(), say) is applied
    to what several of the results come from, so that it's computed once.
    """
    cust, txn = text.strip_names(customers), text.strip_names(transactions)
    amount = numbers.parse_amount(F.col("transaction_amount"))
    txn = txn.withColumn("transaction_amount_orig", F.col("transaction_amount")).withColumn("transaction_amount", amount)
    txn = txn.withColumns({"amount_category": numbers.amount_category(F.col("transaction_amount"), low, high), "transaction_date_parsed": times.parse_date(F.col("transaction_date"))})
    txn = txn.withColumn("transaction_month", F.month("transaction_date_parsed"))
    if "city" in cust.columns:
        cust = cust.withColumns({"city_original": F.col("city"), "city": text.standard_name(F.col("city"))})
    cust, txn = text.trim_strings(cust), text.trim_strings(txn)

    def marked(df: DataFrame, why: str) -> DataFrame:
        return df.withColumn("reason", F.lit(why)) if reasons else df

    cust, cust_copies = rows.split_duplicates(cust, cut)
    txn, txn_copies = rows.split_duplicates(txn, cut)
    missing = text.blank(F.col("customer_id")) | text.blank(F.col("status"))
    if "city" in cust.columns:
        missing = missing | text.blank(F.col("city"))
    cust, cust_bad = rows.split_valid(cust, missing)
    wrong = text.blank(F.col("transaction_id")) | text.blank(F.col("customer_id")) | F.col("transaction_amount").isNull() | (F.col("transaction_amount") <= 0) | F.col("transaction_date_parsed").isNull()
    txn, txn_bad = rows.split_valid(txn, wrong)
    lost, txn = rows.orphans(txn, cust, "customer_id"), rows.referenced(txn, cust, "customer_id")
    return Cleansed(
        cust,
        txn.withColumn("transaction_date", F.date_format("transaction_date_parsed", "yyyy-MM-dd")),
        marked(cust_copies, "duplicate").unionByName(marked(cust_bad, "invalid")),
        marked(txn_copies, "duplicate").unionByName(marked(txn_bad, "invalid")).unionByName(marked(lost, "orphan")),
    )


def customer_aggregates(transactions: DataFrame, customers: DataFrame, k: int = 3) -> dict[str, DataFrame]:
    """The join, totals by customer and by city (if there is one), and the k customers with the largest totals."""
    joined = transactions.join(customers, "customer_id")
    total, n = F.sum("transaction_amount").alias("total_transaction_amount"), F.count("transaction_amount").alias("transaction_count")
    by_customer = joined.groupBy("customer_id", "customer_name").agg(total, F.avg("transaction_amount").alias("average_transaction_amount"), n)
    out = {"joined": joined, "customer": by_customer, "top": rows.top_k(by_customer, "total_transaction_amount", k, ["customer_id", "customer_name"])}
    if "city" in joined.columns:
        out["city"] = joined.groupBy("city").agg(total, n)
    return out


def group_stats(df: DataFrame, key: str, value: str, ps: Sequence[float] = (0.5, 0.95, 0.99), digits: int = 6) -> DataFrame:
    """mean_, std_ (sample), p50_ ..., total_ of value and n for each key, rounded. Nulls don't count."""
    names = [f"p{round(p * 100)}_{value}" for p in ps]
    found = df.groupBy(key).agg(F.mean(value).alias("m"), F.stddev_samp(value).alias("s"), F.sum(value).alias("t"), F.count(value).alias("n"), numbers.percentiles(F.col(value), ps).alias("q"))
    quantiles = [F.round(F.col("q")[i], digits).alias(n) for i, n in enumerate(names)]
    return found.select(key, F.round("m", digits).alias(f"mean_{value}"), F.round("s", digits).alias(f"std_{value}"), *quantiles, F.round("t", digits).alias(f"total_{value}"), "n")


def busiest_trailing_window(df: DataFrame, key: str, value: str, ts: str, seconds: int = 3600) -> DataFrame:
    """(key, max_count): of the key with the largest sum of value (of equal ones the least), the most rows in a trailing window."""
    best = rows.top_k(df.groupBy(key).agg(F.sum(value).alias("total")), "total", 1, [key]).select(key)
    # counts by second first: the window then sorts one row a second, however many rows the key has
    own = df.join(F.broadcast(best), key).groupBy(key, times.epoch(F.col(ts)).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return series.trailing_sum(own, "at", seconds, "n", "in_window", key).groupBy(key).agg(F.max("in_window").alias("max_count"))


def rank_in_window(df: DataFrame, window: str, first: str, second: str, tie: str) -> DataFrame:
    """rank from 1 in each window: by first, then second ascending, nulls first, then tie."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(window).orderBy(F.asc_nulls_first(first), F.asc_nulls_first(second), tie)))
