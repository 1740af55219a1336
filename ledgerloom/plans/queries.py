"""Registered queries of the ledger engine over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..model import TOPIC, PersistenceConfig, Watermarks
from ..operators import backpressure, batching, fencing, ledger, poison, sinks
from ..sources import commands as source
from ..streaming import metrics, state
from ..streaming.runtime import LedgerWriter
from ..streaming.store import LedgerStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CUT, BACK, BATCH = 1500, 500, 500
MARKS = Watermarks(80, 20)

#: The command stream in SQL, and what many queries share.
_COMMANDS = """commands AS (
  SELECT 'ledger-events' AS topic, CAST(user_id % 3 AS INTEGER) AS partition_id,
         row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS offset_value,
         'ACC-' || user_id AS account_number,
         CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT) AS amount,
         event_type AS reason, value, props, ts FROM events)"""
_CHANGES = _COMMANDS + """, changes AS (
  SELECT topic, partition_id, offset_value, account_number, amount, reason,
         CAST(sum(amount) OVER (PARTITION BY account_number ORDER BY topic, partition_id, offset_value) AS BIGINT) AS resulting_balance FROM commands)"""
_STORED = _CHANGES + f""", existing AS (SELECT * FROM changes WHERE offset_value < {CUT}),
incoming AS (SELECT * FROM changes WHERE offset_value >= {CUT - BACK}),
fresh AS (SELECT * FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.topic = i.topic AND e.partition_id = i.partition_id AND e.offset_value = i.offset_value)),
stored_balances AS (SELECT account_number, CAST(sum(amount) AS BIGINT) AS balance FROM existing GROUP BY 1),
tokens AS (SELECT topic, partition_id, max(offset_value) AS num_offset FROM existing GROUP BY 1, 2)"""
_DEPTHS = _COMMANDS + ", samples AS (SELECT topic, partition_id, offset_value, CAST(abs(amount) % 100 AS INTEGER) AS depth FROM commands)"


def _stated(samples: str, order: str = "offset_value", more: str = "") -> str:
    return f"""marked AS (SELECT *, CASE WHEN depth >= {MARKS.high} THEN 1 WHEN depth <= {MARKS.low} THEN 0 END AS mark FROM {samples}),
stated AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY topic, partition_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS now,
  coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY topic, partition_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM marked){more}"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_changes(source.commands(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stored changes, balances and tokens below a cut, and incoming changes that overlap them."""
    changes = _changes(spark, sf_dir)
    existing = changes.where(F.col("offset_value") < CUT)
    incoming = changes.where(F.col("offset_value") >= CUT - BACK)
    tokens = existing.groupBy("topic", "partition_id").agg(F.max("offset_value").alias("num_offset"))
    return existing, incoming, ledger.balances(existing), tokens


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.commands(spark, sf_dir).select("topic", "partition_id", "offset_value", (F.abs("amount") % 100).cast("int").alias("depth"))


def _poison() -> Column:
    return F.col("value") > 300


# ------------------------------------------------------------------ sources


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value, account_number, amount, reason FROM commands")
def src_commands(spark, sf_dir):
    return source.commands(spark, sf_dir).drop("value")


@query(f"WITH {_COMMANDS} SELECT offset_value // {BATCH} AS poll, topic, partition_id, count(*) AS rows, min(offset_value) AS first_offset, max(offset_value) AS last_offset FROM commands GROUP BY 1, 2, 3")
def slice_sizes(spark, sf_dir):
    return ledger.slice_sizes(source.commands(spark, sf_dir), batching.saturated_batch(BATCH))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def decode_json(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return source.decoded(events, "props", "k long")


@query(f"WITH {_STORED} SELECT c.topic, c.partition_id, c.offset_value, c.account_number, c.amount FROM commands c LEFT JOIN tokens t USING (topic, partition_id) WHERE c.offset_value > coalesce(t.num_offset, -1)")
def replay_from_token(spark, sf_dir):
    tokens = _stored(spark, sf_dir)[3]
    return fencing.after_token(source.commands(spark, sf_dir), tokens).select("topic", "partition_id", "offset_value", "account_number", "amount")


@query(f"WITH {_STORED} SELECT 'ledger-events' AS topic, p.partition_id, CAST(coalesce((SELECT max(num_offset) FROM tokens t WHERE t.partition_id = p.partition_id), -1) AS BIGINT) AS num_offset FROM (VALUES (0), (7)) p(partition_id)")
def stored_offset(spark, sf_dir):
    tokens = _stored(spark, sf_dir)[3]
    return fencing.stored_offset(tokens, TOPIC, 0).unionByName(fencing.stored_offset(tokens, TOPIC, 7))


@query(f"WITH {_STORED} SELECT * FROM stored_balances")
def rehydrate_all(spark, sf_dir):
    return _stored(spark, sf_dir)[2]


@query(f"WITH {_CHANGES} SELECT account_number, arg_max(resulting_balance, (topic, partition_id, offset_value)) AS balance FROM changes GROUP BY 1")
def latest_per_account(spark, sf_dir):
    return ledger.latest_per_account(_changes(spark, sf_dir))


@query(f"WITH {_COMMANDS} SELECT partition_id, count(*) AS max_id FROM commands GROUP BY 1")
def max_id(spark, sf_dir):
    return ledger.max_id(ledger.sequence_ids(source.commands(spark, sf_dir)))


@query("SELECT i AS message_id, i AS send_order, 'ACC-' || (i % 1500) AS account_number, CAST(1 AS BIGINT) AS amount, 'credit' AS reason FROM range(150000) t(i)")
def gen_round_robin(spark, sf_dir):
    return source.generated(spark, 150_000, 1_500)


@query("SELECT i AS message_id, CAST('0x' || substr(md5('42:' || i), 1, 15) AS BIGINT) AS send_order, 'ACC-' || (i % 1500) AS account_number, CAST(1 AS BIGINT) AS amount, 'credit' AS reason FROM range(150000) t(i)")
def gen_shuffled(spark, sf_dir):
    return source.generated(spark, 150_000, 1_500, shuffled=True).orderBy("send_order", "message_id")


@query("""SELECT 'ledger-events' AS topic, CAST(0 AS INTEGER) AS partition_id, i AS offset_value, 'ACC-' || CASE WHEN i >= 100000 THEN 0 ELSE i % 1500 END AS account_number,
CAST(CASE WHEN i >= 100000 THEN 1 WHEN i % 2 = 1 THEN -(i % 97 + 1) ELSE i % 97 + 1 END AS BIGINT) AS amount, CASE WHEN i >= 100000 THEN 'flood' WHEN i % 2 = 1 THEN 'debit' ELSE 'credit' END AS reason FROM range(150000) t(i)""")
def gen_signed(spark, sf_dir):
    return source.signed_load(spark, 150_000, 1_500, flood_from=100_000)


@query(f"""WITH {_COMMANDS} SELECT topic, partition_id, offset_value, account_number AS key, '{{"account_number":"' || account_number || '","amount":' || amount || ',"reason":"' || reason || '"}}' AS message FROM commands""")
def encode_json(spark, sf_dir):
    return source.encoded(source.commands(spark, sf_dir).drop("value"), into="message")


#: The key hash in SQL, for ASCII keys: four bytes at a time from the left, then the rest, then the finish.
_M, _MASK = "1540483477::UBIGINT", "4294967295::UBIGINT"
_MURMUR2 = f"""bytes AS (SELECT account_number, list_transform(string_split(account_number, ''), lambda c: ascii(c)::UBIGINT) AS b FROM (SELECT DISTINCT account_number FROM commands)),
folded AS (SELECT account_number, len(b) AS n, b, list_reduce(list_prepend(xor(2538058380::UBIGINT, len(b)::UBIGINT),
  list_transform(list_transform(list_transform(range(0, len(b) // 4), lambda i: ((b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) * {_M}) & {_MASK}), lambda k: xor(k, k >> 24)), lambda k: (k * {_M}) & {_MASK})),
  lambda h, k: xor((h * {_M}) & {_MASK}, k)) AS h FROM bytes),
rested AS (SELECT account_number, CASE n % 4 WHEN 0 THEN h ELSE (xor(h, b[n - n % 4 + 1] + CASE WHEN n % 4 > 1 THEN b[n - n % 4 + 2] * 256 ELSE 0 END + CASE WHEN n % 4 > 2 THEN b[n - n % 4 + 3] * 65536 ELSE 0 END) * {_M}) & {_MASK} END AS h FROM folded),
mixed AS (SELECT account_number, (xor(h, h >> 13) * {_M}) & {_MASK} AS h FROM rested),
hashed AS (SELECT account_number, xor(h, h >> 15)::BIGINT AS h FROM mixed)"""


@query(f"WITH {_COMMANDS}, {_MURMUR2} SELECT account_number, CAST(((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 3 + 3) % 3 AS INTEGER) AS partition_id FROM hashed")
def partition_of_key(spark, sf_dir):
    accounts = source.commands(spark, sf_dir).select("account_number").distinct()
    return accounts.withColumn("partition_id", scalar.partition_of(F.col("account_number"), 3))


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, max(offset_value) + 1 AS size FROM commands GROUP BY 1, 2")
def partition_sizes(spark, sf_dir):
    return ledger.partition_sizes(source.commands(spark, sf_dir))


@query(f"WITH {_COMMANDS}, counted AS (SELECT reason, count(*) AS n, count(*) FILTER (offset_value < {CUT}) AS old FROM commands GROUP BY 1) SELECT reason AS metric, n - old AS n FROM counted")
def stats_delta(spark, sf_dir):
    rows = source.commands(spark, sf_dir)
    after = rows.groupBy(F.col("reason").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    before = rows.where(F.col("offset_value") < CUT).groupBy(F.col("reason").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.minus(after, before, ["metric"], "n")


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value, account_number, amount FROM commands WHERE offset_value >= {CUT}")
def seek_offset(spark, sf_dir):
    return source.seek(source.commands(spark, sf_dir), CUT).select("topic", "partition_id", "offset_value", "account_number", "amount")


# ------------------------------------------------------------------ projections and state


@query(f"WITH {_CHANGES} SELECT topic, partition_id, offset_value, account_number, amount, reason, resulting_balance FROM changes")
def ledger_changes(spark, sf_dir):
    return _changes(spark, sf_dir)


@query(f"WITH {_CHANGES} SELECT topic, partition_id, offset_value, account_number, amount, reason, resulting_balance FROM changes")
def stream_ledger(spark, sf_dir):
    """The change history from keyed state, over the events as a file stream, read to its present end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STATE_STORE)
    work = _work_folder(spark, "stream")
    source.commands(spark, sf_dir).drop("value").write.parquet(f"{work}/in")
    stream = state.stream_ledger(source.file_stream(spark, f"{work}/in", files_per_batch=1_000))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start(f"{work}/out").awaitTermination()
    return spark.read.parquet(f"{work}/out")


def _work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; in one process without that setting, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, topic || '-' || partition_id AS shard, count(*) AS rows FROM commands GROUP BY 1, 2")
def shard_names(spark, sf_dir):
    rows = source.commands(spark, sf_dir).groupBy("topic", "partition_id").agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("shard", scalar.shard_name())


@query(f"WITH {_COMMANDS} SELECT a AS account_number, CAST(coalesce((SELECT sum(amount) FROM commands WHERE account_number = a), 0) AS BIGINT) AS balance FROM (VALUES ('ACC-7'), ('ACC-none')) t(a)")
def balance_of(spark, sf_dir):
    table = ledger.balances(source.commands(spark, sf_dir))
    return ledger.balance_of(table, "ACC-7").unionByName(ledger.balance_of(table, "ACC-none"))


@query(f"WITH {_COMMANDS}, b AS (SELECT account_number, sum(amount) AS balance FROM commands GROUP BY 1) SELECT count(CASE WHEN balance <> 0 THEN 1 END) AS off_target FROM b")
def accounts_off_target(spark, sf_dir):
    return ledger.balances(source.commands(spark, sf_dir)).agg(F.count_if(F.col("balance") != 0).alias("off_target"))


# ------------------------------------------------------------------ sinks


@query(f"WITH {_STORED} SELECT topic, partition_id, offset_value, account_number, amount FROM fresh")
def idempotent_insert(spark, sf_dir):
    existing, incoming, _, _ = _stored(spark, sf_dir)
    return sinks.idempotent_insert(existing, incoming).select("topic", "partition_id", "offset_value", "account_number", "amount")


@query(f"WITH {_STORED} SELECT count(*) AS inserted FROM fresh")
def inserted_count(spark, sf_dir):
    existing, incoming, _, _ = _stored(spark, sf_dir)
    return sinks.idempotent_insert(existing, incoming).agg(F.count(F.lit(1)).alias("inserted"))


@query(f"WITH {_STORED} SELECT account_number, CAST(sum(amount) AS BIGINT) AS delta FROM fresh GROUP BY 1")
def deltas_per_account(spark, sf_dir):
    existing, incoming, _, _ = _stored(spark, sf_dir)
    return sinks.deltas(sinks.idempotent_insert(existing, incoming))


@query(f"WITH {_STORED}, d AS (SELECT account_number, sum(amount) AS delta FROM fresh GROUP BY 1) SELECT account_number, CAST(coalesce(balance, 0) + coalesce(delta, 0) AS BIGINT) AS balance FROM stored_balances FULL JOIN d USING (account_number)")
def balance_upsert_additive(spark, sf_dir):
    existing, incoming, table, _ = _stored(spark, sf_dir)
    return sinks.upsert_additive(table, sinks.idempotent_insert(existing, incoming))


_ABSOLUTE = "SELECT account_number, CAST(coalesce(new, balance) AS BIGINT) AS balance FROM stored_balances FULL JOIN n USING (account_number)"


@query(f"WITH {_STORED}, n AS (SELECT account_number, arg_max(resulting_balance, (topic, partition_id, offset_value)) AS new FROM incoming GROUP BY 1) {_ABSOLUTE}")
def balance_upsert_absolute(spark, sf_dir):
    _, incoming, table, _ = _stored(spark, sf_dir)
    return sinks.upsert_absolute(table, incoming)


@query(f"WITH {_STORED}, n AS (SELECT account_number, arg_max(resulting_balance, (topic, partition_id, offset_value)) AS new FROM fresh GROUP BY 1) {_ABSOLUTE}")
def insert_returning_upsert(spark, sf_dir):
    existing, incoming, table, _ = _stored(spark, sf_dir)
    return sinks.insert_returning_upsert(existing, table, incoming)


_GREATEST = "SELECT topic, partition_id, CAST(greatest(num_offset, new) AS BIGINT) AS num_offset FROM tokens FULL JOIN n USING (topic, partition_id)"


@query(f"WITH {_STORED}, n AS (SELECT topic, partition_id, max(offset_value) AS new FROM incoming WHERE partition_id <> 2 GROUP BY 1, 2) {_GREATEST}")
def offset_greatest(spark, sf_dir):
    _, incoming, _, tokens = _stored(spark, sf_dir)
    return sinks.upsert_offsets(tokens, incoming.where("partition_id <> 2"))


@query(f"WITH {_STORED}, n AS (SELECT topic, partition_id, max(offset_value) AS new FROM incoming GROUP BY 1, 2) {_GREATEST}")
def poll_batch(spark, sf_dir):
    existing, incoming, table, tokens = _stored(spark, sf_dir)
    return sinks.poll_batch(existing, table, tokens, incoming)["offsets"]


@query(f"WITH {_STORED} SELECT topic, partition_id, offset_value, TRUE AS stored_before, CAST(1 AS BIGINT) AS in_batch FROM incoming WHERE offset_value < {CUT}")
def pk_violations(spark, sf_dir):
    existing, incoming, _, _ = _stored(spark, sf_dir)
    return sinks.pk_violations(existing, incoming)


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value, printf('%s amount=%d reason=%s', account_number, amount, reason) AS payload, 'value is above 300' AS cause FROM commands WHERE value > 300")
def dead_letters(spark, sf_dir):
    return sinks.dead_letters(source.commands(spark, sf_dir).where(_poison()), F.lit("value is above 300"))


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value // {BATCH} AS poll, max(offset_value) + 1 AS next_offset FROM commands GROUP BY 1, 2, 3 HAVING bool_and(NOT (partition_id = 1 AND offset_value = 700))")
def commit_offsets(spark, sf_dir):
    """The offset that each whole poll of each log partition commits; a poll with a refused row commits none."""
    return sinks.commit_offsets(_delivered(spark, sf_dir).withColumn("poll", batching.saturated_batch(BATCH)), ("topic", "partition_id", "poll"))


def _delivered(spark, sf_dir):
    return source.commands(spark, sf_dir).withColumn("delivered", ~((F.col("partition_id") == 1) & (F.col("offset_value") == 700)))


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value, account_number FROM commands WHERE NOT (partition_id = 1 AND offset_value >= 700)")
def delivered_prefix(spark, sf_dir):
    return sinks.delivered_prefix(_delivered(spark, sf_dir)).select("topic", "partition_id", "offset_value", "account_number")


@query(f"WITH {_STORED} SELECT account_number, CAST(sum(amount) AS BIGINT) AS stored, CAST(sum(amount) AS BIGINT) AS confirmed FROM commands GROUP BY 1")
def confirmed_equals_balance(spark, sf_dir):
    """Confirmed sums of post-commit events beside stored balances."""
    existing, incoming, table, _ = _stored(spark, sf_dir)
    stored = sinks.upsert_additive(table, sinks.idempotent_insert(existing, incoming)).select("account_number", F.col("balance").alias("stored"))
    confirmed = ledger.latest_per_account(_changes(spark, sf_dir)).select("account_number", F.col("balance").alias("confirmed"))
    return stored.join(confirmed, "account_number", "full_outer")


@query(f"WITH {_CHANGES}, a AS (SELECT account_number, sum(amount) AS balance FROM commands GROUP BY 1), b AS (SELECT account_number, sum(amount) AS balance FROM commands WHERE value <= 300 GROUP BY 1) SELECT account_number, CAST(a.balance AS BIGINT) AS balance_one, CAST(b.balance AS BIGINT) AS balance_two FROM a FULL JOIN b USING (account_number) WHERE a.balance IS DISTINCT FROM b.balance")
def store_diff(spark, sf_dir):
    rows = source.commands(spark, sf_dir)
    return sinks.store_diff(ledger.balances(rows), ledger.balances(rows.where(~_poison())), ["account_number"], ["balance"])


@query(
    f"""WITH {_COMMANDS}, quarters AS (SELECT *, offset_value // (SELECT max(offset_value) // 4 + 1 FROM commands) AS k FROM commands),
committed AS (SELECT k, count(*) FILTER (amount >= -30000) AS changes, count(*) FILTER (amount < -30000) AS dead, max(offset_value) AS most FROM quarters GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS version, changes, dead, max(most) OVER (ORDER BY k) AS max_token FROM committed"""
)
def batch_commit_log(spark, sf_dir):
    """Versions of a store after the whole log in four batches, the third of which is sent again."""
    log = _work_folder(spark, "log")
    source.commands(spark, sf_dir).drop("value").write.parquet(log)
    rows = spark.read.parquet(log)
    quarter = rows.agg(F.coalesce(F.max("offset_value"), F.lit(0))).first()[0] // 4 + 1
    store = LedgerStore(spark, _work_folder(spark, "store"))
    writer = LedgerWriter(store, PersistenceConfig(batch_size=BATCH), violation=F.when(F.col("amount") < -30_000, "amount is below -30000"))
    for k in (0, 1, 2, 2, 3):
        writer.write(rows.where(batching.saturated_batch(quarter) == k))
    return store.commit_log()


# ------------------------------------------------------------------ fencing and ownership

_ATTEMPTS = _COMMANDS + f""", ends AS (SELECT topic, partition_id, max(offset_value) AS new_max FROM commands GROUP BY 1, 2),
attempts AS (
  SELECT topic, partition_id, 'first' AS attempt, CAST(-1 AS BIGINT) AS held_token, new_max, CAST(NULL AS BIGINT) AS stored FROM ends UNION ALL
  SELECT topic, partition_id, 'zombie first', -1, new_max, {CUT} FROM ends UNION ALL
  SELECT topic, partition_id, 'next', {CUT}, new_max, {CUT} FROM ends UNION ALL
  SELECT topic, partition_id, 'same', new_max, new_max, new_max FROM ends UNION ALL
  SELECT topic, partition_id, 'behind', new_max, {CUT}, new_max FROM ends UNION ALL
  SELECT topic, partition_id, 'zombie', {CUT}, new_max, {CUT} + 1 FROM ends),
judged AS (SELECT *, CASE WHEN held_token < 0 THEN CASE WHEN stored IS NULL THEN 'INSERTED' ELSE 'FENCED' END WHEN new_max <= held_token THEN 'NOOP' WHEN stored IS NOT DISTINCT FROM held_token THEN 'ADVANCED' ELSE 'FENCED' END AS outcome FROM attempts)"""


@query(f"WITH {_ATTEMPTS} SELECT *, CASE WHEN outcome IN ('INSERTED', 'ADVANCED') THEN new_max ELSE stored END AS token_after FROM judged")
def fence_outcome(spark, sf_dir):
    ends = source.commands(spark, sf_dir).groupBy("topic", "partition_id").agg(F.max("offset_value").alias("new_max"))
    last, cut = F.col("new_max"), F.lit(CUT).cast("long")
    none = F.lit(None).cast("long")
    cases = [("first", F.lit(-1), last, none), ("zombie first", F.lit(-1), last, cut), ("next", cut, last, cut), ("same", last, last, last), ("behind", last, cut, last), ("zombie", cut, last, cut + 1)]
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("attempt"), h.cast("long").alias("held_token"), m.alias("new_max"), s.alias("stored")) for n, h, m, s in cases]))
    return fencing.fence_outcome(ends.select("topic", "partition_id", one.alias("x")).select("topic", "partition_id", "x.*"))


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value, offset_value // {BATCH} AS poll FROM commands WHERE partition_id = 0 AND offset_value // {BATCH} IN (1, 2)")
def rewind_discard(spark, sf_dir):
    polled = source.commands(spark, sf_dir).select("topic", "partition_id", "offset_value", batching.saturated_batch(BATCH).alias("poll"))
    rewinds = spark.createDataFrame([(TOPIC, 0, 1, 3)], "topic string, partition_id int, from_poll long, seek_poll long")
    return fencing.until_rewound(polled, rewinds)


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value, account_number FROM commands WHERE partition_id IN (0, 2)")
def owned_only(spark, sf_dir):
    mine = spark.createDataFrame([(TOPIC, 0), (TOPIC, 2)], "topic string, partition_id int")
    return fencing.owned_only(source.commands(spark, sf_dir), mine).select("topic", "partition_id", "offset_value", "account_number")


_ASSIGNMENTS = """log AS (SELECT 'ledger-events' AS topic, CAST(user_id AS INTEGER) AS partition_id, 'node-' || (event_id % 3) AS owner,
  CASE event_type WHEN 'signup' THEN 'revoked' WHEN 'error' THEN 'lost' ELSE 'assigned' END AS event, event_id AS event_seq FROM events),
last AS (SELECT *, row_number() OVER (PARTITION BY topic, partition_id ORDER BY event_seq DESC) AS n FROM log)"""


@query(f"WITH {_ASSIGNMENTS} SELECT topic, partition_id, owner FROM last WHERE n = 1 AND event = 'assigned'")
def current_assignment(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "revoked").when(F.col("event_type") == "error", "lost").otherwise("assigned")
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(TOPIC).alias("topic"), F.col("user_id").cast("int").alias("partition_id"), F.concat(F.lit("node-"), (F.col("event_id") % 3).cast("string")).alias("owner"), kind.alias("event"), F.col("event_id").alias("event_seq"))
    return fencing.current_assignment(log)


# ------------------------------------------------------------------ aggregations


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value // {BATCH} AS batch, count(*) AS rows, max(offset_value) AS batch_max_offset FROM commands GROUP BY 1, 2, 3")
def saturated_batches(spark, sf_dir):
    return batching.batches(source.commands(spark, sf_dir), BATCH)


@query(f"WITH {_COMMANDS} SELECT offset_value // {BATCH} AS batch, max(offset_value) AS batch_max_offset FROM commands GROUP BY 1")
def batch_max_offset(spark, sf_dir):
    """The token that each batch over all log partitions would leave."""
    return source.commands(spark, sf_dir).groupBy(batching.saturated_batch(BATCH).alias("batch")).agg(F.max("offset_value").alias("batch_max_offset"))


@query(f"WITH {_COMMANDS} SELECT account_number, partition_id, count(*) AS changes FROM commands GROUP BY 1, 2 UNION ALL SELECT account_number, NULL, count(*) FROM commands GROUP BY 1 UNION ALL SELECT NULL, NULL, count(*) FROM commands")
def change_counts(spark, sf_dir):
    each = source.commands(spark, sf_dir).groupBy("account_number", "partition_id").agg(F.count(F.lit(1)).alias("changes"))
    nothing = F.lit(None)
    accounts = each.groupBy("account_number").agg(F.sum("changes").alias("changes")).select("account_number", nothing.cast("int").alias("partition_id"), "changes")
    total = each.agg(F.sum("changes").alias("changes")).select(nothing.cast("string").alias("account_number"), nothing.cast("int").alias("partition_id"), "changes")
    return each.unionByName(accounts).unionByName(total)


@query(f"WITH {_COMMANDS} SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) AS total_balance FROM commands")
def total_balance(spark, sf_dir):
    return ledger.balances(source.commands(spark, sf_dir)).agg(F.coalesce(F.sum("balance"), F.lit(0)).cast("long").alias("total_balance"))


@query(f"WITH {_COMMANDS} SELECT count(DISTINCT account_number) AS accounts FROM commands")
def distinct_accounts(spark, sf_dir):
    return source.commands(spark, sf_dir).agg(F.countDistinct("account_number").alias("accounts"))


_RANKED = _COMMANDS + ", ranked AS (SELECT partition_id, amount, row_number() OVER (PARTITION BY partition_id ORDER BY amount) - 1 AS k, count(*) OVER (PARTITION BY partition_id) AS n FROM commands)"


@query(f"WITH {_RANKED} SELECT partition_id, amount AS upper_median FROM ranked WHERE k = n // 2")
def upper_median(spark, sf_dir):
    return batching.upper_median(source.commands(spark, sf_dir), "amount", ["partition_id"])


@query(f"WITH {_RANKED} SELECT partition_id, max(n) AS n, max(CASE WHEN k = n * 50 // 100 THEN amount END) AS p50, max(CASE WHEN k = n * 95 // 100 THEN amount END) AS p95, max(CASE WHEN k = n * 99 // 100 THEN amount END) AS p99, max(amount) AS p100 FROM ranked GROUP BY 1")
def nearest_rank_percentiles(spark, sf_dir):
    return batching.percentiles(source.commands(spark, sf_dir), "amount", ["partition_id"], {"p50": "0.5", "p95": "0.95", "p99": "0.99", "p100": "1"})


@query(f"WITH {_COMMANDS}, t AS (SELECT 'p' || partition_id AS approach, reason AS phase, CAST(sum(abs(amount)) AS BIGINT) AS total FROM commands GROUP BY 1, 2) SELECT approach, phase, total // 3 AS per_writer_ms, total // 3 * 1000 // 1000000 AS per_mille FROM t")
def phase_share(spark, sf_dir):
    phases = source.commands(spark, sf_dir).select(F.concat(F.lit("p"), F.col("partition_id").cast("string")).alias("approach"), F.col("reason").alias("phase"), F.abs("amount").alias("millis"))
    return batching.phase_shares(phases, 3, 1_000_000)


@query("WITH m AS (SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'shard-' || (user_id % 3) END AS component, event_type AS metric FROM events) SELECT coalesce(component, 'unknown') AS component, metric, count(*) AS n FROM m GROUP BY 1, 2 UNION ALL SELECT 'total', metric, count(*) FROM m GROUP BY 2")
def metric_counts(spark, sf_dir):
    name = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("shard-"), (F.col("user_id") % 3).cast("string")))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(name.alias("component"), F.col("event_type").alias("metric"))
    return batching.metric_counts(events)


# ------------------------------------------------------------------ windows


_BROKEN = _CHANGES + ", broken AS (SELECT topic, partition_id, offset_value, account_number, amount, CASE WHEN offset_value % 97 = 5 THEN resulting_balance + 1 ELSE resulting_balance END AS resulting_balance FROM changes), lagged AS (SELECT *, lag(resulting_balance) OVER (PARTITION BY account_number ORDER BY topic, partition_id, offset_value) AS previous_balance FROM broken)"


@query(f"WITH {_BROKEN} SELECT * FROM lagged WHERE resulting_balance <> coalesce(previous_balance, 0) + amount")
def out_of_order(spark, sf_dir):
    """A history with every 97th balance off by one: each shows twice, at itself and at the account's next change."""
    off = F.when(F.col("offset_value") % 97 == 5, F.col("resulting_balance") + 1).otherwise(F.col("resulting_balance"))
    return ledger.out_of_order(_changes(spark, sf_dir).withColumn("resulting_balance", off).drop("reason"))


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value, row_number() OVER (PARTITION BY topic, partition_id ORDER BY offset_value) + CASE partition_id WHEN 1 THEN 100 ELSE 0 END AS id FROM commands WHERE value <= 300")
def sequence_ids(spark, sf_dir):
    carried = spark.createDataFrame([(1, 100)], "partition_id int, max_id long")
    return ledger.sequence_ids(source.commands(spark, sf_dir).where(~_poison()), carried).select("topic", "partition_id", "offset_value", "id")


@query(f"WITH {_COMMANDS}, n AS (SELECT topic, partition_id, offset_value, row_number() OVER (PARTITION BY topic, partition_id ORDER BY offset_value) - 1 AS expected_offset FROM commands WHERE value <= 300) SELECT * FROM n WHERE offset_value <> expected_offset")
def offset_gaps(spark, sf_dir):
    return ledger.offset_gaps(source.commands(spark, sf_dir).where(~_poison()).select("topic", "partition_id", "offset_value"))


_APPLIED = _COMMANDS + f""", applied AS (SELECT topic, partition_id, offset_value, offset_value AS applied_seq FROM commands WHERE offset_value < {CUT}
  UNION ALL SELECT topic, partition_id, offset_value, offset_value + {BACK} FROM commands WHERE offset_value >= {CUT - BACK}),
seen AS (SELECT *, max(offset_value) OVER (PARTITION BY topic, partition_id ORDER BY applied_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM applied)"""


@query(f"WITH {_APPLIED} SELECT topic, partition_id, offset_value, applied_seq FROM seen WHERE offset_value <= most")
def replayed_records(spark, sf_dir):
    rows = source.commands(spark, sf_dir).select("topic", "partition_id", "offset_value")
    first = rows.where(F.col("offset_value") < CUT).withColumn("applied_seq", F.col("offset_value"))
    again = rows.where(F.col("offset_value") >= CUT - BACK).withColumn("applied_seq", F.col("offset_value") + BACK)
    return ledger.replayed(first.unionByName(again))


# ------------------------------------------------------------------ sorting and batches


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value, reason AS body FROM commands ORDER BY topic, partition_id, offset_value")
def bodies_in_order(spark, sf_dir):
    return source.commands(spark, sf_dir).select("topic", "partition_id", "offset_value", F.col("reason").alias("body")).orderBy("topic", "partition_id", "offset_value")


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value, account_number FROM commands ORDER BY topic, partition_id, offset_value LIMIT {BATCH}")
def first_batch(spark, sf_dir):
    return sinks.first_batch(source.commands(spark, sf_dir).select("topic", "partition_id", "offset_value", "account_number"), BATCH)


_RUNS = _COMMANDS + ", runs AS (SELECT partition_id AS round, reason AS approach, count(*) AS rows, CAST(sum(abs(amount)) AS BIGINT) AS wall_ms FROM commands GROUP BY 1, 2)"


@query(f"WITH {_RUNS} SELECT round, approach, rows, wall_ms, rows * 1000 // greatest(1, wall_ms) AS rows_per_s FROM runs ORDER BY 1, 2")
def run_report(spark, sf_dir):
    runs = source.commands(spark, sf_dir).groupBy(F.col("partition_id").alias("round"), F.col("reason").alias("approach")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.abs("amount")).cast("long").alias("wall_ms"))
    return batching.run_report(runs)


# ------------------------------------------------------------------ poison records


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value, CASE WHEN value > 300 THEN 'value is above 300' END AS violation, NOT value > 300 AS valid FROM commands")
def split_valid_poison(spark, sf_dir):
    return poison.split(source.commands(spark, sf_dir), F.when(_poison(), "value is above 300")).select("topic", "partition_id", "offset_value", "violation", "valid")


_FIRST = _COMMANDS + ", judged AS (SELECT *, min(CASE WHEN {bad} THEN offset_value END) OVER (PARTITION BY topic, partition_id) AS f FROM commands)"


@query(f"WITH {_FIRST.format(bad='value > 300')} SELECT topic, partition_id, offset_value, CASE WHEN f IS NULL OR offset_value < f THEN 'PERSISTED' WHEN offset_value = f THEN 'DEAD' ELSE 'ABANDONED' END AS outcome FROM judged")
def poison_one_pass(spark, sf_dir):
    return poison.one_pass(source.commands(spark, sf_dir), _poison()).select("topic", "partition_id", "offset_value", "outcome")


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, count(CASE WHEN value <= 300 THEN 1 END) AS persisted, count(CASE WHEN value > 300 THEN 1 END) AS dead, count(CASE WHEN value > 300 THEN 1 END) AS halts, max(offset_value) AS token FROM commands GROUP BY 1, 2")
def poison_converged(spark, sf_dir):
    return poison.summary(poison.converged(source.commands(spark, sf_dir), _poison()))


@query(f"WITH {_FIRST.format(bad="value > 300 OR reason = 'error'")} SELECT topic, partition_id, offset_value, CASE WHEN f IS NULL OR offset_value < f THEN 'PERSISTED' WHEN offset_value = f THEN CASE WHEN reason = 'error' THEN 'HALTED' ELSE 'DEAD' END ELSE 'ABANDONED' END AS outcome FROM judged")
def transient_in_isolation(spark, sf_dir):
    return poison.one_pass(source.commands(spark, sf_dir), _poison(), F.col("reason") == "error").select("topic", "partition_id", "offset_value", "outcome")


_ERRORS = """errors(sqlstate, message) AS (VALUES ('08006', 'lost'), ('40001', 'deadlock'), ('23505', 'duplicate key'), (NULL, 'Connection refused'), (NULL, 'Broken Pipe'), ('22001', 'value too long'), (NULL, NULL), ('42000', 'read TIMEOUT'), ('08', ''), ('23000', 'statement closed'))"""


@query(f"WITH {_ERRORS} SELECT sqlstate, message, CASE WHEN coalesce(sqlstate, '') LIKE '08%' OR coalesce(sqlstate, '') LIKE '40%' OR regexp_matches(lower(coalesce(message, '')), 'connection|network|socket|refused|timeout|closed|broken pipe|reset by peer') THEN 'transient' ELSE 'single_item' END AS error_class FROM errors")
def classify_errors(spark, sf_dir):
    rows = [("08006", "lost"), ("40001", "deadlock"), ("23505", "duplicate key"), (None, "Connection refused"), (None, "Broken Pipe"), ("22001", "value too long"), (None, None), ("42000", "read TIMEOUT"), ("08", ""), ("23000", "statement closed")]
    errors = spark.createDataFrame(rows, "sqlstate string, message string")
    return errors.withColumn("error_class", scalar.error_class(F.col("sqlstate"), F.col("message")))


# ------------------------------------------------------------------ backpressure


@query(f"WITH {_DEPTHS}, {_stated('samples')} SELECT topic, partition_id, offset_value, depth, CASE now WHEN 1 THEN 'ENGAGED' ELSE 'RELEASED' END AS edge FROM stated WHERE now <> before")
def backpressure_edges(spark, sf_dir):
    return backpressure.edges(_depths(spark, sf_dir), MARKS)


_TICKS = _DEPTHS + ", ticked AS (SELECT topic, partition_id, offset_value, depth, offset_value * 2 AS sample_seq, 'input' AS source FROM samples UNION ALL SELECT topic, partition_id, offset_value, depth // 4, offset_value * 2 + 1, 'tick' FROM samples)"


@query(f"WITH {_TICKS}, {_stated('ticked', 'sample_seq')} SELECT topic, partition_id, offset_value, depth, sample_seq FROM stated WHERE now <> before AND now = 0 AND source = 'tick'")
def release_on_tick(spark, sf_dir):
    samples = backpressure.with_ticks(_depths(spark, sf_dir), F.expr("cast(depth div 4 as int)"))
    return backpressure.edges(samples, MARKS, "sample_seq").where("edge = 'RELEASED' and source = 'tick'").select("topic", "partition_id", "offset_value", "depth", "sample_seq")


_CLEARED = _DEPTHS + ", kept AS (SELECT * FROM samples s WHERE offset_value <= (SELECT max(offset_value) FROM samples e WHERE e.partition_id = s.partition_id AND depth >= 80)), cleared AS (SELECT * FROM kept UNION ALL SELECT topic, partition_id, max(offset_value) + 1, 0 FROM kept GROUP BY 1, 2)"


@query(f"WITH {_CLEARED}, {_stated('cleared')} SELECT topic, partition_id, offset_value, CASE now WHEN 1 THEN 'ENGAGED' ELSE 'RELEASED' END AS edge FROM stated WHERE now <> before")
def release_on_clear(spark, sf_dir):
    """Depths up to the last engaging one of each log partition, whose buffer is then cleared."""
    samples = _depths(spark, sf_dir)
    last = samples.where(F.col("depth") >= MARKS.high).groupBy("partition_id").agg(F.max("offset_value").alias("last"))
    kept = samples.join(last, "partition_id").where("offset_value <= last").select("topic", "partition_id", "offset_value", "depth")
    return backpressure.edges(backpressure.with_clear(kept), MARKS).select("topic", "partition_id", "offset_value", "edge")


@query(f"WITH {_DEPTHS}, {_stated('samples')} SELECT topic, partition_id, offset_value, depth FROM stated WHERE before = 1")
def reject_while_engaged(spark, sf_dir):
    return backpressure.rejected(_depths(spark, sf_dir), MARKS)


@query(f"WITH {_DEPTHS}, {_stated('samples')} SELECT topic, partition_id, offset_value, depth, CASE WHEN before = 1 THEN 'RAN_BY_CALLER' ELSE 'QUEUED' END AS outcome FROM stated")
def caller_runs_while_engaged(spark, sf_dir):
    return backpressure.admitted(_depths(spark, sf_dir), MARKS, "CALLER_RUNS")


@query(f"WITH {_DEPTHS}, {_stated('samples')}, turned AS (SELECT *, lead(offset_value) OVER (PARTITION BY topic, partition_id ORDER BY offset_value) AS resumed_at FROM stated WHERE now <> before) SELECT topic, partition_id, offset_value AS paused_at, resumed_at FROM turned WHERE now = 1")
def pause_intervals(spark, sf_dir):
    return backpressure.pauses(_depths(spark, sf_dir), MARKS)


# ------------------------------------------------------------------ retries, restarts, timers


@query("SELECT n AS attempt, least(50 * (1 << least(n - 1, 20)), 5000) AS delay_ms FROM range(1, 31) t(n)")
def retry_backoff(spark, sf_dir):
    return spark.range(1, 31).select(F.col("id").alias("attempt"), scalar.retry_delay(F.col("id")).alias("delay_ms"))


@query("SELECT n AS restart, least(100 * (1 << ((n - 1) % 10)), 30000) AS delay_ms FROM range(1, 31) t(n)")
def restart_backoff(spark, sf_dir):
    return spark.range(1, 31).select(F.col("id").alias("restart"), scalar.restart_delay(F.col("id")).alias("delay_ms"))


_REQUESTS = "requests AS (SELECT 'ledger-events' AS topic, CAST(p AS INTEGER) AS partition_id, i * 1000 + p AS requested_at_ms, i FROM range(12) a(i), range(3) b(p))"


@query(f"WITH {_REQUESTS}, d AS (SELECT *, least(100 * (1 << (i % 10)), 30000) AS delay_ms FROM requests) SELECT topic, partition_id, requested_at_ms, CAST(step_no AS INTEGER) AS step_no, step, requested_at_ms + CASE WHEN step_no > 3 THEN delay_ms ELSE 0 END AS due_ms FROM d, (VALUES (0, 'pause'), (1, 'begin_rewind'), (2, 'stop'), (3, 'wait'), (4, 'start'), (5, 'resume')) s(step_no, step)")
def restart_sequence(spark, sf_dir):
    requests = spark.range(12).crossJoin(spark.range(3).withColumnRenamed("id", "p")).select(F.lit(TOPIC).alias("topic"), F.col("p").cast("int").alias("partition_id"), (F.col("id") * 1000 + F.col("p")).alias("requested_at_ms"))
    return batching.restart_trace(requests)


@query("WITH t AS (SELECT 'ledger-events' AS topic, CAST(user_id % 3 AS INTEGER) AS partition_id, CAST(event_id // 100 AS BIGINT) AS generation, event_id AS due_ms FROM events WHERE event_type = 'error') SELECT *, generation < max(generation) OVER (PARTITION BY topic, partition_id) AS stale FROM t")
def stale_restart_timers(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'")
    timers = events.select(F.lit(TOPIC).alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition_id"), F.expr("event_id div 100").alias("generation"), F.col("event_id").alias("due_ms"))
    return batching.live_restarts(timers)


@query("WITH t AS (SELECT event_id AS timer_id, 'ACC-' || user_id AS actor, event_id AS set_at_ms, CAST(event_id * 37 % 500 AS BIGINT) AS delay_ms, event_id + event_id * 37 % 500 AS due_ms FROM events), live AS (SELECT * FROM t WHERE NOT (actor = 'ACC-1' AND due_ms >= 2000)) SELECT timer_id, actor, set_at_ms, delay_ms, due_ms, row_number() OVER (PARTITION BY actor ORDER BY due_ms, set_at_ms, timer_id) AS fire_order FROM live")
def timers_in_order(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    timers = events.select(F.col("event_id").alias("timer_id"), F.concat(F.lit("ACC-"), F.col("user_id").cast("string")).alias("actor"), F.col("event_id").alias("set_at_ms"), (F.col("event_id") * 37 % 500).alias("delay_ms"))
    return batching.fire_timers(timers, spark.createDataFrame([("ACC-1", 2000)], "actor string, stopped_at_ms long"))


@query(f"WITH {_COMMANDS} SELECT topic, partition_id, offset_value, CAST(k AS INTEGER) AS effect_no, CASE k WHEN 0 THEN 'confirm ' ELSE 'notify ' END || account_number AS effect FROM commands, range(2) r(k) WHERE value <= 300 AND (k = 0 OR amount < 0) ORDER BY 1, 2, 3, 4")
def side_effects_in_order(spark, sf_dir):
    """Each committed change confirms its account; a debit also notifies it."""
    committed = source.commands(spark, sf_dir).where(~_poison())
    confirm, notify = F.concat(F.lit("confirm "), F.col("account_number")), F.concat(F.lit("notify "), F.col("account_number"))
    effects = F.when(F.col("amount") < 0, F.array(confirm, notify)).otherwise(F.array(confirm))
    return batching.side_effects(committed.withColumn("side_effects", effects)).orderBy("topic", "partition_id", "offset_value", "effect_no")


@query("SELECT CASE WHEN bool_and(running) THEN 'UP' ELSE 'DOWN' END AS status, count(*) AS containers, count(CASE WHEN NOT running THEN 1 END) AS not_running FROM (SELECT DISTINCT user_id % 7 AS c, user_id % 7 <> 4 AS running FROM events)")
def health(spark, sf_dir):
    status = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 7).alias("c"), (F.col("user_id") % 7 != 4).alias("running")).distinct()
    return batching.healthy(status)
