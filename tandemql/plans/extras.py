"""What the other modules leave out: rarer predicates, LATERAL, subqueries in odd places, files, recovery, plans and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemql.plans.registry import Registry, Tables, through_session
from tandemql.session import Session
from tandemql.storage import fresh_path

registry = Registry()


def _same(name: str, dialect: str, sql: str, oracle: str | None = None) -> None:
    def build(t: Tables) -> DataFrame:
        return through_session(t, dialect, sql)

    build.__name__ = name
    registry.query(oracle or sql)(build)


_same("like_escape", "postgres", "SELECT n_name FROM nation WHERE n_name LIKE '%N!_1_' ESCAPE '!' OR n_name NOT LIKE 'NATION!_%' ESCAPE '!'")
_same("like_escape_mysql", "mysql", "SELECT n_name FROM nation WHERE n_name LIKE 'nation|__' ESCAPE '|'", "SELECT n_name FROM nation WHERE n_name ILIKE 'nation|__' ESCAPE '|'")
_same("sounds_like", "mysql", "SELECT r_name FROM region WHERE r_name SOUNDS LIKE 'Ashia'", "SELECT r_name FROM region WHERE r_name = 'ASIA'")
_same("member_of", "mysql", "SELECT n_name FROM nation WHERE n_regionkey MEMBER OF (ARRAY[1, 3])", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
_same("lateral", "postgres", "SELECT r.r_name, x.n, x.hi FROM region r, LATERAL (SELECT COUNT(*) AS n, MAX(n_nationkey) AS hi FROM nation WHERE n_regionkey = r.r_regionkey) x")
_same("sub_in_on", "postgres", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND r_regionkey < (SELECT AVG(r_regionkey) FROM region)")
_same("sub_in_group_by", "mysql", "SELECT n_regionkey > (SELECT AVG(r_regionkey) FROM region) AS high, COUNT(*) AS n FROM nation GROUP BY n_regionkey > (SELECT AVG(r_regionkey) FROM region)")
_same("sub_in_order_by", "postgres", "SELECT n_name FROM nation ORDER BY n_regionkey - (SELECT MAX(r_regionkey) FROM region) DESC, n_name LIMIT 4")
_same("sub_in_case", "mysql", "SELECT r_name, CASE WHEN r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey > 20) THEN 'late' ELSE 'none' END AS w FROM region")
_same("sub_text_in_numbers", "mysql", "SELECT n_name FROM nation WHERE '3x' IN (SELECT r_regionkey FROM region) AND n_regionkey IN (SELECT CONCAT(r_regionkey, '.0') FROM region)", "SELECT n_name FROM nation")


@registry.query("SELECT * FROM (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) AS v(col_name)")
def describe_table(t: Tables) -> DataFrame:
    return through_session(t, "mysql", "DESCRIBE nation").select("col_name")


@registry.query("SELECT TRUE AS planned")
def explain_query(t: Tables) -> DataFrame:
    return through_session(t, "postgres", "EXPLAIN SELECT COUNT(*) FROM nation").select(F.contains("plan", F.lit("Physical Plan")).alias("planned"))


@registry.query("SELECT op, TRUE AS refused FROM (VALUES ('UNION ALL'), ('INTERSECT'), ('EXCEPT')) AS v(op)")
def setop_arity(t: Tables) -> DataFrame:
    """Sides of unlike width are an error before anything runs."""
    told = []
    for op in ("UNION ALL", "INTERSECT", "EXCEPT"):
        try:
            through_session(t, "mysql", f"SELECT n_name FROM nation {op} SELECT r_name, r_regionkey FROM region")
            told.append((op, False))
        except Exception as error:  # the analysis error that is meant, or a failure of the query
            told.append((op, "NUM_COLUMNS_MISMATCH" in str(error)))
    return t.spark.createDataFrame(told, "op string, refused boolean")


@registry.query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def outfile_and_load(t: Tables) -> DataFrame:
    """A table out to text files by INTO OUTFILE, and in again by LOAD DATA."""
    session, at = Session(t.spark, "mysql"), fresh_path(t.spark, "outfile")
    session.register("customer", t.customer)
    session.register("copy", t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").limit(0))
    shape = "FIELDS TERMINATED BY ';' ENCLOSED BY '\"'"
    session.execute_query(f"SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer INTO OUTFILE '{at}' {shape}")
    session.execute(f"LOAD DATA INFILE '{at}' INTO TABLE copy {shape}")
    return session.execute_query("SELECT * FROM copy")


@registry.query("SELECT shard, k FROM (SELECT 'a' AS shard, n_nationkey + 100 AS k FROM nation UNION ALL SELECT 'b', n_nationkey + 100 FROM nation UNION ALL SELECT 'c', n_nationkey FROM nation) x")
def txn_recovery(t: Tables) -> DataFrame:
    """A crash between the decision and the last manifest, and one before any decision; then recovery, twice."""
    from tandemql.transactions.two_phase import ShardStore, TwoPhaseTransaction, recover
    from tandemql.transactions.wal import SharedDecisionLog

    store = ShardStore(t.spark, fresh_path(t.spark, "recovery"))
    log = SharedDecisionLog(store.files)
    keys = t.nation.select(F.col("n_nationkey").alias("k"))

    def begun(shards: str, by: int) -> TwoPhaseTransaction:
        txn = TwoPhaseTransaction(store, log)
        for shard in shards:
            txn.write(shard, keys.select((F.col("k") + by).alias("k")))
        return txn

    begun("abc", 0).commit()
    decided = begun("ab", 100)
    decided.prepare()
    log.decide("COMMIT", decided.txn, ["a", "b"])
    store.publish("a", decided.txn)
    begun("bc", 200).prepare()
    for _ in range(2):
        recover(store, log)
    parts = [store.read(s).select(F.lit(s).alias("shard"), "k") for s in "abc"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


HOURS = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total, max(value) AS most FROM events GROUP BY 1, 2"


@registry.query(f"SELECT start, event_type, n, round(total, 4) AS total, most FROM ({HOURS}) x")
def stream_windows(t: Tables) -> DataFrame:
    """The events as a stream, counted by hour: the windows when the stream has no more to read."""
    from tandemql.streaming.windows import event_stream, windowed

    at = fresh_path(t.spark, "stream")
    events = event_stream(t.spark, f"{t.sf_dir}/events.parquet")
    stream = windowed(events).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint")
    done = stream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/windows")).trigger(availableNow=True).start()
    done.awaitTermination()
    return t.spark.read.parquet(f"{at}/windows").withColumn("total", F.round("total", 4))


@registry.query(f"SELECT start, event_type, n, round(total, 4) AS total, most FROM ({HOURS}) x")
def batch_windows(t: Tables) -> DataFrame:
    from tandemql.streaming.windows import windowed

    return windowed(t.events).withColumn("total", F.round("total", 4))
