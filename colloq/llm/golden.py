"""Golden records by order-preserving binary keys (operator 12).

A cluster's records are reduced to one, field by field. What decides between two records is packed
into bytes whose order is the rule's order: staleness, trust, inverted microseconds, client_id.
So ``min`` over bytes, which combines before the shuffle, chooses every winner; the client_id at a
key's end is decoded, and a join by client_id recovers the winners' values.

A first aggregation gives each cluster's latest time, which staleness needs. It meets the records
by a shuffle; clusters with more than 1 / ``HOT`` of all records, fewer than ``HOT``, meet theirs
by broadcast, so no task gets a large cluster.

Defined results: the source, untrimmed, has a trust if it is listed, else the lowest; blank strings
count as null; a balance that is no finite number counts as null; null client_ids come last in ties
and null clusters are one cluster; rows of one client_id that tie in every part of a key give the
smallest value (nulls of an address first); repeated rows count as records of their own; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Sources by falling trust.
TRUST = ("partner", "store", "web", "crm")
STALE_MICROS = 30 * 24 * 3_600_000_000
#: Clusters that are broadcast: fewer than this, a row of about 30 bytes each.
HOT = 10_000

_SIGN = "shiftleft(1L, 63)"
_BLANK = "^[ \\\\x09-\\\\x0D]*\\\\z"


def _ordered(x: str) -> str:
    """Hex digits whose order is that of the long ``x``."""
    return f"lpad(hex(({x}) ^ {_SIGN}), 16, '0')"


def _micros(clients: DataFrame) -> str:
    """Microseconds since 1970: of the time as written if it has no zone, whatever the session's zone."""
    if dict(clients.dtypes)["updated_at"] != "timestamp_ntz":
        return "unix_micros(cast(updated_at as timestamp))"
    return ("unix_date(cast(updated_at as date)) * 86400000000L + hour(updated_at) * 3600000000L + minute(updated_at) * 60000000L"
            " + cast(extract(second from updated_at) * 1000000 as bigint)")  # fmt: skip


def records(clients: DataFrame) -> DataFrame:
    """The columns that count, blanks as null, with cluster_id, microseconds and trust (0 is best)."""
    trust = " ".join(f"when '{s}' then {k}" for k, s in enumerate(TRUST))
    strings = (f"if({c} rlike '{_BLANK}', null, {c}) as {c}" for c in ("name", "email", "city", "segment"))
    return clients.selectExpr(
        "cast(coalesce(master_id, client_id) as bigint) as cluster_id", "cast(client_id as bigint) as client_id",
        f"{_micros(clients)} as micros", f"case source {trust} else {len(TRUST)} end as trust", *strings, "nation_id",
        "if(isnan(balance) or abs(balance) = double('Infinity'), null, floor(100D * balance + 0.5D)) as cents",
    )


def _with_latest(found: DataFrame) -> DataFrame:
    """Adds ``latest``, the cluster's latest microseconds, to every record."""
    per = written(found.groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("micros").alias("latest")), "clusters")
    total = per.agg(F.sum("n")).first()[0] or 0
    key = lambda t: F.col("r.cluster_id").eqNullSafe(F.col(f"{t}.cluster_id"))
    hot = F.broadcast(per.filter(F.col("n") > total // HOT).limit(HOT)).alias("h")
    rows = found.alias("r")
    many = rows.join(hot, key("h")).select("r.*", "h.latest")
    few = rows.join(hot, key("h"), "left_anti").alias("r").join(per.hint("merge").alias("p"), key("p")).select("r.*", "p.latest")
    return many.unionByName(few)


def keyed(clients: DataFrame) -> DataFrame:
    """Records with their packed keys, in a written table."""
    rows = _with_latest(records(clients)).withColumn("stale", F.expr(f"micros is null or latest - micros > {STALE_MICROS}L"))
    rows = rows.withColumn("recent", F.expr(
        f"unhex(concat(if(micros is null, '01', '00'), {_ordered('~coalesce(micros, 0L)')}, lpad(hex(trust), 2, '0'),"
        f" if(client_id is null, '01', '00'), {_ordered('coalesce(client_id, 0L)')}))"))  # fmt: skip
    rows = rows.withColumn("trusted", F.expr("unhex(concat(if(stale, '01', '00'), lpad(hex(trust), 2, '0'))) || recent"))
    rows = rows.withColumn("named", F.expr("unhex(lpad(hex(2147483647 - length(name)), 8, '0')) || trusted"))
    rows = rows.withColumn("placed", F.expr("unhex(lpad(hex(if(city is null, 1, 0) + if(nation_id is null, 1, 0)), 2, '0')) || trusted"))
    return written(rows.drop("micros", "trust", "latest"), "keyed")


def winners(rows: DataFrame) -> DataFrame:
    """cluster_id, n_records, n_stale and the least key for each field.

    Counted by (cluster, segment) first, so that the balance key of the chosen segment is at hand.
    """
    mine = rows.groupBy("cluster_id", "segment").agg(
        F.expr("count(*) as n"), F.expr("count_if(stale) as n_stale"), F.expr("min(named) as named"), F.expr("min(placed) as placed"),
        F.expr("min(if(email is not null, trusted, null)) as mailed"), F.expr("min(if(segment is not null, recent, null)) as chosen"),
        F.expr("min(if(cents is not null, recent, null)) as paid"),
    )
    all_ = mine.groupBy("cluster_id").agg(
        F.expr("sum(n) as n_records"), F.expr("sum(n_stale) as n_stale"), F.expr("min(named) as named"), F.expr("min(placed) as placed"),
        F.expr("min(mailed) as mailed"), F.expr("min(if(chosen is not null, struct(chosen, segment, paid), null)) as first"), F.expr("min(paid) as paid"),
    )
    return all_.selectExpr("cluster_id", "n_records", "n_stale", "named", "mailed", "placed", "first.chosen as chosen", "coalesce(first.paid, paid) as paid")


def golden(clients: DataFrame) -> DataFrame:
    """One record for each cluster_id, with the client_ids that its fields are from."""
    rows = keyed(clients)
    asked = winners(rows).selectExpr(
        "cluster_id", "n_records", "n_stale", "stack(5, 'name', named, 'email', mailed, 'segment', chosen, 'balance', paid, 'address', placed) as (field, key)"
    ).filter("key is not null")  # every cluster has an address key
    asked = asked.withColumn("from_id", F.expr(
        f"if(substr(key, -9, 1) = x'01', null, cast(conv(hex(substr(key, -8)), 16, -10) as bigint) ^ {_SIGN})"))
    a, r = asked.alias("a"), rows.alias("r")
    same = F.expr("a.cluster_id <=> r.cluster_id and a.from_id <=> r.client_id and "
                  "a.key = case a.field when 'name' then r.named when 'email' then r.trusted when 'address' then r.placed else r.recent end")  # fmt: skip
    found = a.join(r.hint("merge"), same).selectExpr(
        "a.cluster_id", "n_records", "n_stale", "field", "from_id", "name", "email", "segment", "cents", "struct(city, nation_id) as address",
        "city is not null or nation_id is not null as placed_at",
    )
    one = lambda field, value: f"min(if(field = '{field}', {value}, null))"
    return found.groupBy("cluster_id").agg(
        F.expr("max(n_records) as n_records"), F.expr("max(n_stale) as n_stale"), F.expr(f"{one('name', 'name')} as name"),
        F.expr(f"{one('email', 'email')} as email"), F.expr(f"{one('segment', 'segment')} as segment"), F.expr(f"{one('address', 'address')} as address"),
        F.expr(f"{one('balance', 'cents')} as balance_cents"), *(F.expr(f"{one(f, 'from_id')} as {f}_from") for f in ("name", "email", "segment", "balance")),
        F.expr("min(if(field = 'address' and placed_at, from_id, null)) as address_from"),
    ).selectExpr("cluster_id", "n_records", "n_stale", "name", "email", "segment", "address.city as city", "address.nation_id as nation_id",
                 "balance_cents", "name_from", "email_from", "segment_from", "balance_from", "address_from")


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    trust = " ".join(f"when '{s}' then {k}" for k, s in enumerate(TRUST))
    clean = ", ".join(f"case when regexp_full_match({c}, '[ \\x09-\\x0D]*') then null else {c} end as {c}" for c in ("name", "email", "city", "segment"))
    return f"""
with r as (select coalesce(master_id, client_id) as cluster_id, client_id, updated_at, case source {trust} else {len(TRUST)} end as trust,
    {clean}, nation_id, case when isfinite(balance) then floor(100 * balance + 0.5)::bigint end as cents from clients),
s as (select *, updated_at is null or max(updated_at) over (partition by cluster_id) - updated_at > interval 720 hours as stale from r),
t as (select *, row_number() over (partition by cluster_id order by updated_at desc nulls last, trust, client_id nulls last) as recent from s),
u as (select *, row_number() over (partition by cluster_id order by stale, trust, recent) as trusted,
    first_value(segment) over (partition by cluster_id order by segment is null, recent) as chosen from t),
v as (select *, row_number() over (partition by cluster_id order by length(name) desc nulls last, trusted) as k_name,
    row_number() over (partition by cluster_id order by email is null, trusted) as k_email,
    row_number() over (partition by cluster_id order by segment is null, recent) as k_segment,
    row_number() over (partition by cluster_id order by cents is null, not coalesce(segment = chosen, false), recent) as k_balance,
    row_number() over (partition by cluster_id order by (city is null)::int + (nation_id is null)::int, trusted) as k_address from u)
select cluster_id, count(*) as n_records, count_if(stale)::bigint as n_stale,
    max(name) filter (k_name = 1) as name, max(email) filter (k_email = 1) as email, max(segment) filter (k_segment = 1) as segment,
    max(city) filter (k_address = 1) as city, max(nation_id) filter (k_address = 1) as nation_id, max(cents) filter (k_balance = 1) as balance_cents,
    max(client_id) filter (k_name = 1 and name is not null) as name_from, max(client_id) filter (k_email = 1 and email is not null) as email_from,
    max(client_id) filter (k_segment = 1 and segment is not null) as segment_from, max(client_id) filter (k_balance = 1 and cents is not null) as balance_from,
    max(client_id) filter (k_address = 1 and (city is not null or nation_id is not null)) as address_from
from v group by cluster_id
"""
