"""Per-key operators in batch form: privacy budget, admission, sessions, breaker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Noise, RateLimit, Screening, Vault


def budget_decisions(df: DataFrame, subject: str, ts: str, tie: str, cost: str, cfg: Noise = Noise()) -> DataFrame:
    """Adds ``epoch, spent_before, allowed, charged``.

    A subject's ledger starts anew after ``idle_reset_hours`` without a request. Denial is final within an epoch since
    the sum only grows, so a prefix sum of all costs decides exactly. The last allowed request may overspend.
    """
    order = Window.partitionBy(subject).orderBy(ts, tie)
    gap = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.lag(F.col(ts).cast("timestamp")).over(order))
    df = df.withColumn("__new", F.coalesce((gap >= cfg.idle_reset_hours * 3600).cast("int"), F.lit(0)))
    df = df.withColumn("epoch", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(subject, "epoch").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__before", F.coalesce(F.sum(cost).over(within), F.lit(0.0)))
    allowed = F.lit(cfg.budget) - F.col("__before") > 0
    charged = F.when(allowed, F.col(cost)).otherwise(F.lit(0.0))
    df = df.withColumn("allowed", allowed).withColumn("charged", charged)
    return df.withColumn("spent_before", F.coalesce(F.sum("charged").over(within), F.lit(0.0))).drop("__new", "__before")


def client_key(forwarded: F.Column, remote: F.Column, limit: int = 45) -> F.Column:
    """The first forwarded hop of 1 to ``limit`` characters, else the remote address. The hop is the client's word."""
    hop = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(F.length(hop).between(1, limit), hop).otherwise(remote)


def budget_subject(forwarded: F.Column, remote: F.Column) -> F.Column:
    hop = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(F.length(hop) > 0, hop).otherwise(remote)


def token_bucket(df: DataFrame, client: str, ts: str, tie: str, cfg: RateLimit = RateLimit()) -> DataFrame:
    """(client, tie, ts, admitted): an ordered fold per client in integer microtokens, the same in batch and stream.

    A client's requests meet in one task as narrow structs (time and id); the stream form keeps two numbers per client.
    """
    cap = int(cfg.capacity * 60_000_000)
    rate = cfg.per_minute  # 1 token = 60e6 units, so a microsecond refills `per_minute` units

    def step(a, x):
        level = F.least(F.lit(cap), a["level"] + ((x["us"] - a["last"]) * F.lit(rate)).cast("long"))
        level = F.when(a["last"] < 0, F.lit(cap)).otherwise(level)
        ok = level >= 60_000_000
        return F.struct(F.when(ok, level - 60_000_000).otherwise(level).cast("long").alias("level"), x["us"].alias("last"), F.concat(a["acc"], F.array(F.struct(x["tie"].alias("tie"), x["us"].alias("us"), ok.alias("admitted")))).alias("acc"))

    kind = dict(df.dtypes)[tie]
    start = F.struct(F.lit(cap).cast("long").alias("level"), F.lit(-1).cast("long").alias("last"), F.expr(f"cast(array() as array<struct<tie:{kind},us:bigint,admitted:boolean>>)").alias("acc"))
    events = df.select(F.col(client).alias("client"), F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(tie).alias("tie")).alias("e")).groupBy("client").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return events.select("client", F.explode(F.aggregate("es", start, step, lambda a: a["acc"])).alias("d")).select("client", F.col("d.tie").alias(tie), F.timestamp_micros("d.us").cast(dict(df.dtypes)[ts]).alias(ts), F.col("d.admitted").alias("admitted"))


def sessions(df: DataFrame, key: str, ts: str, cfg: Vault = Vault()) -> DataFrame:
    """(key, started, expires, requests): vault sessions end after ``ttl_minutes`` without use."""
    return df.groupBy(key, F.session_window(ts, f"{cfg.ttl_minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("requests")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "requests")


#: Rows of a chunk that make another chunk worth while, and the most chunks; neither changes a result.
CHUNK_ROWS = 1 << 16
CHUNKS = 256


def _chunked(rows: DataFrame, chunk_rows: int) -> tuple[DataFrame, int]:
    """``rows`` (key, s, tie, failed) dealt to chunks, a partition each, that follow one another in the order of key, time
    (nulls last), tie (nulls last); sorted so within. The bounds come from a sample: any bounds give right results."""
    at = F.struct("key", F.col("s").isNull().alias("no_s"), "s", F.col("tie").isNull().alias("no_tie"), "tie", "failed")
    n = rows.count()
    chunks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // chunk_rows), CHUNKS)
    bounds = []
    if chunks > 1:
        places = rows.sample(min(1.0, 100 * chunks / n), 1).select(at.alias("at")).sort("at").collect()
        bounds = [r["at"] for r in places[:: max(1, -(-len(places) // chunks))][1:]]
    chunk = F.lit(0)
    if bounds:
        kinds = {f.name: f.dataType for f in rows.select(at.alias("at")).schema["at"].dataType.fields}
        table = F.array(*[F.struct(*[F.lit(b[k]).cast(t).alias(k) for k, t in kinds.items()]) for b in bounds])
        steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
        chunk = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, d: F.when((lo + d <= len(bounds)) & (F.get(table, lo + d - 1) <= at), lo + d).otherwise(lo))
    dealt = rows.withColumn("chunk", chunk).repartitionById(len(bounds) + 1, F.col("chunk"))
    return dealt.sortWithinPartitions("chunk", "key", F.asc_nulls_last("s"), F.asc_nulls_last("tie"), "failed"), len(bounds) + 1


def _breaker(limit: int, seconds: int):
    """(pieces, walk): runs of one key within sorted Arrow batches, and the breaker over such a run.

    A state is (fails, ready): with ``fails`` under the limit the breaker is closed, else it skips the rows before
    ``ready``. A closed breaker opens where ``limit`` failures end that all are its own, an open one goes on at a probe, so
    a walk has a step for each opening and each probe, and walks that meet go on as one.
    """
    def pieces(batch):
        """(key, s, failed, from, to) of each run of one key; s is None where the time is null."""
        n = batch.num_rows
        key, s = batch.column("key"), batch.column("s")
        code = key.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        none = s.is_null().to_numpy(zero_copy_only=False)
        s, failed = s.fill_null(0).to_numpy(), batch.column("failed").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (none[1:] != none[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
            if b > a:
                yield key[a].as_py(), None if none[a] else s[a:b], failed[a:b], a, b

    def walk(s, failed, states, mark=None):
        """The state after the run, for each state before it; ``mark`` is told of the rows of each step."""
        n = len(failed)
        at = np.arange(n)
        run = at - np.maximum.accumulate(np.where(failed, -1, at))  # failures that end here
        lead, tail = int(np.argmin(failed)) if not failed.all() else n, int(run[-1])
        if s is None:  # no probe time is ever reached: each row counts, whether it is known to be called or not
            if mark:
                fails = np.where(at < lead, at + 1 + states[0][0], run)
                mark(None, np.concatenate([[min(states[0][0], limit)], fails[:-1]]) >= limit, fails >= limit)
            return [(min(f + n if lead == n else tail, limit), r) for f, r in states]
        opens = np.flatnonzero(run >= limit)
        where = np.searchsorted(opens, at + limit - 1)
        opening = np.append(opens, n)[where].tolist()
        probe = np.searchsorted(s, s + seconds).tolist()
        bad, time = failed.tolist(), s.tolist()
        known = {}

        def from_closed(i, fails):
            if not fails:
                return opening[i]
            if lead >= limit - fails:  # failures from before the run are there at its first row only
                return limit - fails - 1
            return opening[lead] if lead < n else n

        ends = []
        for fails, ready in states:
            i, is_open, path, end = 0, fails >= limit, [], None
            if is_open:
                i = int(np.searchsorted(s, ready))
                if mark:
                    mark(0, i, False, True)
            carried = 0 if is_open else fails
            while end is None:
                if i >= n:
                    end = (limit, ready) if is_open else (carried + n if carried and lead == n else 0, 0)
                    break
                node = (i, is_open, carried)
                if node in known and not mark:
                    end = known[node]
                    break
                path.append(node)
                if is_open:  # a probe
                    if mark:
                        mark(i, i + 1, True, bad[i])
                    if bad[i]:
                        ready, j = time[i] + seconds, probe[i]
                        if mark:
                            mark(i + 1, j, False, True)
                        i = j
                    else:
                        is_open, i = False, i + 1
                    continue
                j = from_closed(i, carried)
                if j >= n:
                    if mark:
                        mark(i, n, True, False)
                    end = (carried + n if carried and lead == n else min(tail, n - i), 0)
                    break
                if mark:
                    mark(i, j, True, False)
                    mark(j, j + 1, True, True)
                    mark(j + 1, probe[j], False, True)
                is_open, ready, carried, i = True, time[j] + seconds, 0, probe[j]
            for node in path:
                known[node] = end
            ends.append(end)
        return ends

    return pieces, walk


def breaker_states(df: DataFrame, key: str, ts: str, tie: str, failed: str, cfg: Screening = Screening(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, tie, called, open): calls are skipped while a breaker is open; after its time one probe decides.

    A key's rows may be many, so its fold is cut into chunks of the order of time. A chunk is walked from every state it
    can begin in (a count of failures, or a second at which the open breaker lets a probe through), the chunks' maps are
    applied one after the other, and then each chunk is walked from the state it does begin in. Rows without a time come
    last; whether an open breaker calls them is unknown (null), and they count. A null ``failed`` is no failure.
    """
    limit, seconds = cfg.breaker_failures, cfg.breaker_seconds
    rows = df.select(F.col(key).alias("key"), F.unix_seconds(F.col(ts).cast("timestamp")).alias("s"), F.col(tie).alias("tie"), F.coalesce(failed, F.lit(False)).alias("failed"))
    dealt, chunks = _chunked(rows, chunk_rows)
    pieces, walk = _breaker(limit, seconds)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def ends(batches):
        """(chunk, key, last, base, fails, ready): the first key and, for each state that its rows can begin in, the state
        after them; the last key, with the state after its rows from a closed breaker if it is another."""
        first, current, base, chunk, states, fresh = None, None, None, None, None, [(0, 0)]
        for batch in batches:
            for k, s, bad, _, _ in pieces(batch):
                if states is None:
                    first, base, chunk = k, None if s is None else int(s[0]), batch.column("chunk")[0].as_py()
                    states = [(f, 0) for f in range(limit)] + [(limit, (base or 0) + w) for w in range(1 if s is None else seconds + 1)]
                    current = k
                if k != current:
                    current, fresh = k, [(0, 0)]
                if current == first:
                    distinct = list(dict.fromkeys(states))
                    after = dict(zip(distinct, walk(s, bad, distinct), strict=True))
                    states = [after[x] for x in states]
                else:
                    fresh = walk(s, bad, fresh)
        if states is not None:
            made, kind, longs = states if current == first else states + fresh, batch.column("key").type, pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "key": pa.array([first], kind), "last": pa.array([current], kind), "base": pa.array([base], pa.int64()), "fails": pa.array([[f for f, _ in made]], longs), "ready": pa.array([[r for _, r in made]], longs)})

    begin = {}
    if chunks > 1:
        maps = dealt.mapInArrow(ends, f"chunk int, key {kinds['key']}, last {kinds['key']}, base long, fails array<long>, ready array<long>").collect()
        before, state = None, (0, 0)
        for r in sorted(maps, key=lambda r: r["chunk"]):
            if before is not None and before["last"] == r["key"]:
                begin[r["chunk"]] = state
            else:
                state = (0, 0)
            if r["key"] != r["last"]:  # the map of the first key ends in this chunk
                at = -1
            elif state[0] < limit:
                at = state[0]
            else:
                at = limit + (0 if r["base"] is None else min(max(state[1] - r["base"], 0), seconds))
            state, before = (r["fails"][at], r["ready"][at]), r

    def fold(batches):
        current, state, started = None, (0, 0), False
        for batch in batches:
            called, opened, unknown = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for k, s, bad, a, b in pieces(batch):
                if not started:
                    current, state, started = k, begin.get(batch.column("chunk")[0].as_py(), (0, 0)), True
                elif k != current:
                    current, state = k, (0, 0)
                if s is None:

                    def mark(_, was, now, a=a, b=b):
                        called[a:b], unknown[a:b], opened[a:b] = True, was, now

                else:

                    def mark(i, j, c, o, a=a):
                        called[a + i : a + j], opened[a + i : a + j] = c, o

                state = walk(s, bad, [state], mark)[0]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tie"), pa.array(called, mask=unknown), pa.array(opened)], names=["key", tie, "called", "open"])

    return dealt.mapInArrow(fold, f"key {kinds['key']}, `{tie}` {kinds['tie']}, called boolean, open boolean")
