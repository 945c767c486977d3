"""Registered queries over files, reports, raw tables and SQL text."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from millrace import catalog, sinks
from millrace.functions import text, times
from millrace.operators import rows
from millrace.plans import batch, classify, scd
from millrace.registry import query, t
from millrace.scratch import Scratch
from millrace.sources import files


def place(spark):
    """A new place in the shared folder."""
    return Scratch(spark).path()


# files


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def csv_strings(spark, sf):
    path = place(spark)
    sinks.write_csv(t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path, single=True)
    return files.csv_strings(spark, path)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, o_orderstatus FROM orders")
def csv_typed(spark, sf):
    """Cells that don't fit the declared types are null, their rows stay."""
    path = place(spark)
    price = F.when(F.col("o_orderkey") % 7 == 0, "bad").otherwise(F.col("o_totalprice").cast("string"))
    sinks.write_csv(t(spark, sf, "orders").select("o_orderkey", price.alias("price"), "o_orderstatus"), path)
    return files.csv_typed(spark, path, "o_orderkey long, price double, o_orderstatus string")


@query("SELECT p_partkey, p_retailprice, CAST(p_size AS BIGINT) AS p_size, p_brand FROM part")
def csv_inferred(spark, sf):
    path = place(spark)
    sinks.write_csv(t(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size", "p_brand"), path)
    own = files.csv_inferred(spark, path)
    assert dict(own.dtypes)["p_retailprice"] == "double"
    return own.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_retailprice", F.col("p_size").cast("long").alias("p_size"), "p_brand")


@query(f"SELECT b.bin || ',' || coalesce(n, 0) AS value FROM {catalog._BINS} LEFT JOIN (SELECT {catalog._BIN} AS bin, count(*) AS n FROM events GROUP BY 1) c ON b.bin = c.bin")
def text_histogram(spark, sf):
    path = place(spark)
    sinks.write_text(batch.time_of_day_histogram(t(spark, sf, "events"), "ts"), path, single=True)
    return files.text_lines(spark, path)


@query("SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS value FROM nation")
def whole_texts(spark, sf):
    path = place(spark)
    sinks.write_text(t(spark, sf, "nation").orderBy("n_nationkey").select("n_name"), path, single=True)
    return files.whole_texts(spark, f"{path}/*.txt", strict=True).select("value")


_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


@query(f"SELECT doc_id, count(*) AS n, CAST(max(length(line)) AS BIGINT) AS longest FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '({_ENDS})$', ''), '{_ENDS}')) AS line FROM documents WHERE text <> '') GROUP BY doc_id")
def split_lines(spark, sf):
    own = batch.lines_of(t(spark, sf, "documents"), "text", ["doc_id"], batch.SPLITLINES)
    return own.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("line")).cast("long").alias("longest"))


@query("SELECT CAST(label AS DOUBLE) AS label, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last FROM embeddings")
def libsvm(spark, sf):
    path = place(spark)
    own = t(spark, sf, "embeddings").select(F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    sinks.write_libsvm(own, path)
    size = own.select(F.size(vector_to_array("features"))).first()[0]
    back = files.libsvm(spark, path, size).select("label", vector_to_array("features").alias("v"))
    return back.select("label", F.col("v")[0].alias("first"), F.element_at("v", -1).alias("last"))


@query("SELECT CAST(4 AS BIGINT) AS n")
def smoke_count(spark, sf):
    return files.smoke_count(spark)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name LIMIT 5")
def preview(spark, sf):
    return sinks.preview(t(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_name"), 5)


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS key, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def json_messages(spark, sf):
    return sinks.as_messages(t(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("SELECT event_id, CASE WHEN event_id % 10 <> 3 THEN 'in/' || event_id || '.csv' END AS name, CASE WHEN event_id % 10 <> 3 THEN event_type END AS bucket FROM events")
def push_envelopes(spark, sf):
    """Base64 JSON as a push brings it; what doesn't parse has null fields."""
    event = F.struct(F.col("event_type").alias("bucket"), F.concat(F.lit("in/"), "event_id", F.lit(".csv")).alias("name"))
    data = F.when(F.col("event_id") % 10 == 3, "%%%").otherwise(F.base64(F.to_json(event).cast("binary")))
    own = files.push_messages(t(spark, sf, "events").select("event_id", data.alias("data")))
    return own.select("event_id", F.col("event.name").alias("name"), F.col("event.bucket").alias("bucket"))


@query("SELECT i AS id, 'Product_' || i AS product_name, i - 1000 AS seconds, true AS valid FROM range(1000, 2000) r(i)")
def product_events(spark, sf):
    own = files.product_events(spark, 1000, 1000)
    valid = F.col("category").isin(*files.CATEGORIES) & F.col("region").isin(*files.REGIONS) & F.col("price").between(10, 999.99) & F.col("quantity").between(1, 100) & F.col("score").between(1, 5) & (F.round("score", 2) == F.col("score"))
    seconds = F.unix_seconds(F.col("timestamp").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01T00:00:00").cast("timestamp"))
    return own.select(F.col("id").cast("long").alias("id"), "product_name", seconds.alias("seconds"), valid.alias("valid"))


# reports

_OBJECTS = "SELECT 'uploads/doc_' || doc_id || '.txt' AS name, coalesce(text, '') AS value FROM documents"


def objects(spark, sf):
    return t(spark, sf, "documents").select(F.concat(F.lit("uploads/doc_"), "doc_id", F.lit(".txt")).alias("name"), F.col("text").alias("value"))


def _longest(ends):
    """SQL: (name, line_no, line) of each object's longest lines."""
    return f"""SELECT name, CAST(r.n AS BIGINT) AS line_no, r.line AS line FROM (SELECT name, unnest(list_transform(range(1, len(x) + 1), lambda i: {{'n': i, 'line': x[i]}})) AS r
 FROM (SELECT name, string_split_regex(regexp_replace(value, '({ends})$', ''), '{ends}') AS x FROM ({_OBJECTS}) WHERE value <> '')) QUALIFY length(r.line) = max(length(r.line)) OVER (PARTITION BY name)"""


_HEADS = f"SELECT o.name, coalesce(max(length(line)), -1) AS n, count(line) AS k FROM ({_OBJECTS}) o LEFT JOIN l ON o.name = l.name GROUP BY o.name"


@query(
    f"""WITH l AS ({_longest(r'\r\n|\r|\n')}), h AS ({_HEADS})
SELECT name, CAST(-5 AS BIGINT) AS position, 'Source: s3://' || name AS value FROM h UNION ALL SELECT name, -4, 'Max length (characters, excluding newline): ' || n FROM h
 UNION ALL SELECT name, -3, 'Number of longest lines: ' || k FROM h UNION ALL SELECT name, -2, '' FROM h UNION ALL SELECT name, -1, 'Longest line(s):' FROM h
 UNION ALL SELECT name, line_no, '[Line ' || line_no || '] (' || length(line) || ' chars): ' || line FROM l"""
)
def longest_report(spark, sf):
    return batch.longest_reports(objects(spark, sf), "name", "value", prefix="s3://", least=-1)


#: SQL: the shorter report of each object.
PLAIN = f"""WITH l AS ({_longest(_ENDS)}), h AS ({_HEADS.replace('-1', '0')})
SELECT name, CAST(-3 AS BIGINT) AS position, 'Input file: ' || replace(name, 'uploads/', '') AS value FROM h UNION ALL SELECT name, -2, 'Maximum line length: ' || n FROM h
 UNION ALL SELECT name, -1, 'Longest line(s):' FROM h UNION ALL SELECT name, line_no, line FROM l"""


@query(PLAIN)
def longest_report_plain(spark, sf):
    return batch.longest_reports(objects(spark, sf), "name", "value", numbered=False)


@query("""SELECT n_name AS report, concat_ws(chr(10), 'Input file: ' || n_name, 'Maximum line length: ' || greatest(length(n_name), length(r_name)), 'Longest line(s):',
 CASE WHEN length(n_name) >= length(r_name) THEN n_name END, CASE WHEN length(r_name) >= length(n_name) THEN r_name END) || chr(10) AS value FROM nation JOIN region ON n_regionkey = r_regionkey""")
def written_reports(spark, sf):
    path = place(spark)
    own = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.concat_ws("\n", "n_name", "r_name").alias("value"))
    batch.write_reports(batch.longest_reports(own, "name", "value", numbered=False), path)
    return spark.read.text(path, wholetext=True).select("report", "value")


@query("SELECT doc_id, source || '.v1' AS stem, 'in/' || source || '.v1_longest_lines.txt' AS beside, 'out/' || source || '.v1_vm_longest.txt' AS placed FROM documents")
def object_names(spark, sf):
    name = F.concat(F.lit("in/"), "source", F.lit(".v1.txt"))
    return t(spark, sf, "documents").select("doc_id", text.stem(name).alias("stem"), text.report_name(name).alias("beside"), text.report_name(name, "_vm_longest.txt", "out/").alias("placed"))


# raw tables


@query(
    f"""WITH c AS (SELECT CASE WHEN event_id % 8 = 4 THEN 'unknown' ELSE {catalog._BIN} END AS bin FROM events WHERE event_id % 8 > 2)
SELECT bin, CAST(sum(n) AS BIGINT) AS click_count, CAST(CASE bin WHEN '0-6' THEN 0 WHEN '6-12' THEN 1 WHEN '12-18' THEN 2 WHEN '18-24' THEN 3 ELSE 4 END AS BIGINT) AS ordinal FROM (SELECT bin, 1 AS n FROM c UNION ALL SELECT bin, 0 FROM {catalog._BINS}) GROUP BY bin"""
)
def raw_clicks(spark, sf):
    """Raw lines, among them headers, lines without a comma or a time, hours of one digit and hours that no day has."""
    k = F.col("event_id") % 8
    day, rest = F.date_format("ts", "yyyy-MM-dd "), F.date_format("ts", ":mm:ss")
    line = F.when(k == 0, "user_id,timestamp").when(k == 1, "no comma here").when(k == 2, "u, bad").when(k == 3, F.concat(F.lit("u, "), day, F.hour("ts").cast("string"), rest)).when(k == 4, F.concat(F.lit("u,"), day, F.lit("27:00:00")))
    lines = t(spark, sf, "events").select(line.otherwise(F.concat(F.lit("u,"), day, F.date_format("ts", "HH"), rest)).alias("value"))
    own = batch.time_of_day_histogram(batch.clicks_from_lines(lines), "ts", keep_unknown=True, hour="hour")
    return batch.in_day_order(own).withColumn("ordinal", F.col("ordinal").cast("long"))


_SECONDS = "(hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT))"


@query(
    f"""SELECT station AS "Station Name", round(avg(v), 6) AS mean_duration, round(stddev_samp(v), 6) AS std_duration, round(quantile_cont(v, 0.5), 6) AS p50_duration, round(quantile_cont(v, 0.95), 6) AS p95_duration, round(quantile_cont(v, 0.99), 6) AS p99_duration, round(sum(v), 6) AS total_duration, count(v) AS n
 FROM (SELECT event_type AS station, CASE WHEN event_id % 17 = 0 THEN NULL ELSE abs({_SECONDS} - ({_SECONDS} + event_id % 600 * 7) % 86400) / 60 END AS v FROM events WHERE event_id % 13 <> 0) GROUP BY station"""
)
def timetable(spark, sf):
    """From raw text: rows with a null in any column go, a time that isn't one gives no duration."""
    at = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")

    def shown(c):
        return F.format_string("%02d:%02d:%02d", F.floor(c / 3600), F.floor(c % 3600 / 60), c % 60)

    k = F.col("event_id")
    raw = t(spark, sf, "events").select(F.col("event_type").alias("Station Name"), shown(at.cast("long")).alias("Arrival Time"), F.when(k % 17 == 0, "late").otherwise(shown((at + k % 600 * 7) % 86400)).alias("Departure Time"), F.when(k % 13 != 0, "x").alias("Train"))
    return batch.timetable_stats(raw)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def parsed_dates(spark, sf):
    """Dates of many forms."""
    k, c = F.col("o_orderkey") % 7, F.col("o_orderdate")
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "yyyyMMdd", "d MMM yyyy", "yyyy-MM-dd HH:mm:ss"]
    raw = F.lit("n/a")
    for i, form in enumerate(forms):
        raw = F.when(k == i, F.date_format(c, form)).otherwise(raw)
    return t(spark, sf, "orders").select("o_orderkey", times.parse_any_date(raw).alias("day"))


@query("SELECT n_name AS name_nation, r_name AS name_region, n_regionkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey")
def merged(spark, sf):
    left = t(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"))
    right = t(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return rows.merge(left, right, ["k"], ("_nation", "_region"))


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'five', least(5, count(*)) FROM orders")
def row_counts(spark, sf):
    return rows.row_counts(customer=t(spark, sf, "customer"), orders=t(spark, sf, "orders"), five=t(spark, sf, "orders").limit(5))


def _described(c):
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS p25, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"


@query(_described("l_quantity") + " UNION ALL " + _described("l_linenumber"))
def described(spark, sf):
    own = rows.describe(t(spark, sf, "lineitem"), ["l_quantity", "l_linenumber"])
    return own.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT count(*) AS n, true AS all_distinct, true AS stamped FROM orders")
def stamped(spark, sf):
    own = t(spark, sf, "orders").select(F.uuid().alias("id"), F.current_timestamp().alias("at"))
    return own.agg(F.count("*").alias("n"), (F.countDistinct("id") == F.count("*")).alias("all_distinct"), (F.count("at") == F.count("*")).alias("stamped"))


_RAW = """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name, CASE c_custkey % 3 WHEN 0 THEN '2020-01-01' WHEN 1 THEN 'soon' END AS effective_date, CASE c_custkey % 4 WHEN 0 THEN 'x' ELSE '1' END AS current_flag FROM customer"""


@query(f"SELECT customer_id, customer_name, try_cast(effective_date AS DATE) AS effective_date, try_cast(current_flag AS INTEGER) AS current_flag FROM ({_RAW})")
def scd_typed(spark, sf):
    """Raw text columns of a dimension table, typed; what doesn't fit is null."""
    k = F.col("c_custkey")
    raw = t(spark, sf, "customer").select(k.cast("string").alias("customer_id"), F.col("c_name").alias("customer_name"), F.when(k % 3 == 0, "2020-01-01").when(k % 3 == 1, "soon").alias("effective_date"), F.when(k % 4 == 0, "x").otherwise("1").alias("current_flag"))
    return scd.typed(raw)


@query(catalog.oracle_sql()["top5_customers"])
def sql_top5(spark, sf):
    return scd.run_sql("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount FROM {orders} GROUP BY o_custkey ORDER BY total_amount DESC, o_custkey LIMIT 5", orders=t(spark, sf, "orders"))


@query(catalog.oracle_sql()["customers_per_city"])
def sql_customers_per_city(spark, sf):
    return scd.run_sql("SELECT n_name AS city, count(DISTINCT c_custkey) AS customer_count FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name", customer=t(spark, sf, "customer"), nation=t(spark, sf, "nation"))


@query(catalog.oracle_sql()["avg_transaction"])
def sql_avg_transaction(spark, sf):
    return scd.run_sql("SELECT round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS average_transaction_value FROM {orders}", orders=t(spark, sf, "orders"))


@query(catalog.oracle_sql()["scd1_final"])
def sql_scd1(spark, sf):
    """The type 1 merge as SQL text with common table expressions."""
    master, updates = catalog._scd(spark, sf)
    return scd.run_sql(
        """WITH now AS (SELECT * FROM {master} WHERE current_flag = 1),
 changed AS (SELECT u.customer_id, u.customer_name, u.city, coalesce(now.effective_date, u.change_date) AS effective_date, now.expiry_date, coalesce(now.current_flag, 1) AS current_flag FROM {updates} u LEFT JOIN now ON now.customer_id = u.customer_id),
 same AS (SELECT customer_id, customer_name, city, effective_date, expiry_date, current_flag FROM now c LEFT ANTI JOIN {updates} u ON c.customer_id = u.customer_id)
SELECT * FROM changed UNION ALL SELECT * FROM same""",
        master=master,
        updates=updates,
    )


@query(f"SELECT DISTINCT customer_id, customer_name, trim(status) AS status FROM ({catalog._DIRTY_CUST}) WHERE trim(status) <> ''")
def cleansed_without_city(spark, sf):
    cust, txn = catalog._dirty(spark, sf)
    return batch.cleanse(cust.drop("city"), txn).customers.select("customer_id", "customer_name", "status")


# sampling and learning


@query("SELECT CAST(least(10, count(*)) AS BIGINT) AS exact_rows, true AS bounded, true AS from_table FROM events")
def sample_bounds(spark, sf):
    events = t(spark, sf, "events")
    some, exact = rows.sample_rows(events, 10).select("event_id"), rows.sample_rows(events, 10, exact=True).select("event_id")
    found = rows.row_counts(some=some, exact=exact, lost=some.unionByName(exact).join(events, "event_id", "left_anti"))
    n = found.groupBy().pivot("name", ["some", "exact", "lost"]).agg(F.first("n"))
    return n.select(F.col("exact").alias("exact_rows"), (F.col("some") <= 10).alias("bounded"), (F.col("lost") == 0).alias("from_table"))


def digits(spark, sf):
    return t(spark, sf, "embeddings").select(F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query("""SELECT CAST(d AS BIGINT) AS maxDepth, CAST(b AS BIGINT) AS maxBins, CAST(i AS BIGINT) AS minInstancesPerNode, true AS scored FROM (VALUES (5), (10), (15)) x(d), (VALUES (32), (64)) y(b), (VALUES (1), (2)) z(i)""")
def dt_grid(spark, sf):
    """The sets that cross-validation tries, each with an accuracy, of which the largest is the model's."""
    found = classify.train(digits(spark, sf))
    best = max(m for _, m in found.tried)
    right = best == found.accuracy and found.parameters in [p for p, m in found.tried if m == best]
    return spark.createDataFrame([(p["maxDepth"], p["maxBins"], p["minInstancesPerNode"], bool(right and 0 <= m <= 1)) for p, m in found.tried], "maxDepth long, maxBins long, minInstancesPerNode long, scored boolean")


@query("SELECT count(*) AS n, true AS same, true AS likeliest, CAST(5 AS BIGINT) AS max_depth, true AS accurate FROM embeddings")
def dt_saved(spark, sf):
    """A saved model predicts what the trained one does: the likeliest label; and what it's right in is its accuracy."""
    own, path = digits(spark, sf), place(spark)
    found = classify.train(own, (5,), (32,), (1,))
    classify.save(found, path, spark)
    back, noted = classify.load(path), classify.load_metadata(path, spark)
    label = F.expr("array_position(from_json(probability_str, 'array<double>'), array_max(from_json(probability_str, 'array<double>'))) - 1D")
    ours, theirs = classify.predict(found.model, own), classify.predict(back, own)
    pairs = ours.groupBy("label", "prediction", "probability_str").count().join(theirs.groupBy("label", "prediction", "probability_str").count(), ["label", "prediction", "probability_str", "count"], "full")
    total = pairs.agg(F.sum("count").alias("a")).first()["a"]
    checked = theirs.agg(F.count("*").alias("n"), F.bool_and(F.col("prediction") == label).alias("likeliest"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("share"))
    accuracy = classify.accuracy(theirs).first()[0]
    return checked.select("n", (F.col("n") == total).alias("same"), "likeliest", F.lit(noted["maxDepth"]).cast("long").alias("max_depth"), (F.col("share") == accuracy).alias("accurate"))
