"""DuckDB SQL that computes the registered queries by other means.

Draws are looked up in a table of Poisson distribution functions, copies are
numbered by one window per key, and rows are joined without any salting, so a
mistake in the way the library splits the work cannot appear on both sides.
"""

from __future__ import annotations

import hashlib
import string

SEED = 7
SITES = 4
FRACTION = 0.05
HOT_FRACTION = 0.001
OVERLAP = 0.5
RPK = (4, 12)
KEY_SIZE = 16
VALUE_SIZE = 8
ZIPF = 2.0
VALUES = ("value_one", "value_two", "value_three", "value_four", "value_five")

#: Tables around customer: name, id, key, customer's key.
CHAIN = [
    ("supplier", "s_suppkey", "s_nationkey", "c_nationkey"),
    ("orders", "o_orderkey", "o_custkey", "c_custkey"),
]

ORDERS = "SELECT o_orderkey AS id, o_custkey AS k FROM orders"
EVENTS = "SELECT event_id AS id, user_id AS k FROM events"


def salts(purpose: str, seed: int) -> list[int]:
    digest = hashlib.md5(f"{purpose}|{seed}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16)]


def mix(number: str, purpose: str, seed: int = SEED) -> str:
    """52 bits of a BIGINT by multiplications and shifts of its two words."""
    one, two, three = salts(purpose, seed)
    word = 4294967295
    low = f"(xor({number}, {number} >> 29) & {word})"
    high = f"xor(({number} >> 31) & {word}, (({number} & {word}) * 1935289751) & {word})"

    def times_factors(x: str) -> str:
        x = f"(({x} * 569420461) & {word})"
        return f"((xor({x}, {x} >> 15) * 1935289751) & {word})"

    x = f"xor({times_factors(f'xor({low}, {one})')}, xor({high}, {two}))"
    x = times_factors(f"xor({x}, {x} >> 16)")
    rest = times_factors(f"xor({high}, {three})")
    rest = f"((xor({rest}, {rest} >> 16) * 569420461) & {word})"
    return f"(({x} >> 6) * 67108864 + ({rest} >> 6))"


def uniform(bits: str) -> str:
    return f"((cast({bits} AS double) + 5e-1) * {2.0**-52!r})"


def row_bits(id_: str, side: str, text_ids: bool) -> str:
    """Bits of a row: of its whole number, or of 104 bits of its text's md5."""
    if not text_ids:
        return mix(id_, side)
    first, second = (f"cast('0x' || substr(md5({id_}), {i}, 13) AS bigint)" for i in (1, 14))
    return mix(f"xor({mix(first, side)}, {second})", side)


def double(x: float) -> str:
    return f"cast('{x!r}' AS double)"


def with_draws(left: str, right: str, fraction: float, text_ids: bool = False) -> str:
    """CTEs l, r (id, k), wl, wr (with weight), cdf, dl, dr (with copies), cl, cr (per copy).

    Column b holds the bits of a row and u the uniform number made of them.
    """
    return f"""
WITH l AS ({left}), r AS ({right}),
lc AS (SELECT k, count(*) AS n FROM l GROUP BY k),
rc AS (SELECT k, count(*) AS n FROM r GROUP BY k),
bl AS (SELECT id, k, {row_bits("id", "left", text_ids)} AS b FROM l),
br AS (SELECT id, k, {row_bits("id", "right", text_ids)} AS b FROM r),
wl AS (SELECT id, bl.k, b, {uniform("b")} AS u, rc.n AS weight FROM bl JOIN rc ON bl.k = rc.k),
wr AS (SELECT id, br.k, b, {uniform("b")} AS u, lc.n AS weight FROM br JOIN lc ON br.k = lc.k),
{steps_of("(SELECT weight FROM wl UNION SELECT weight FROM wr)", fraction)},
dl AS (SELECT wl.id, wl.k, wl.b, wl.weight, s.n AS copies FROM wl JOIN steps s
       ON wl.weight = s.weight AND wl.u > s.lo AND wl.u <= s.hi WHERE s.n > 0),
dr AS (SELECT wr.id, wr.k, wr.b, wr.weight, s.n AS copies FROM wr JOIN steps s
       ON wr.weight = s.weight AND wr.u > s.lo AND wr.u <= s.hi WHERE s.n > 0),
cl AS (SELECT id, k, b, weight, unnest(generate_series(1, copies)) AS copy FROM dl),
cr AS (SELECT id, k, b, weight, unnest(generate_series(1, copies)) AS copy FROM dr)"""


def with_pairs(left: str, right: str, fraction: float, text_ids: bool = False) -> str:
    """The same, and pairs (k, lid, rid) by zipping."""

    def slots(side: str, copies: str) -> str:
        order = mix("xor(b, copy)", f"{side}-slot")
        return (
            f"SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY {order}, id, copy)"
            f" AS slot FROM {copies}"
        )

    return f"""{with_draws(left, right, fraction, text_ids)},
sl AS ({slots("left", "cl")}), sr AS ({slots("right", "cr")}),
pairs AS (SELECT sl.k, sl.id AS lid, sr.id AS rid
          FROM sl JOIN sr ON sl.k = sr.k AND sl.slot = sr.slot)"""


def orders_with_events(ctes: str) -> str:
    return f"""{ctes}
SELECT o.o_custkey, o.o_orderkey, o.o_orderstatus, o.o_totalprice,
       e.event_id, e.event_type, e.value
FROM pairs JOIN orders o ON o.o_orderkey = pairs.lid JOIN events e ON e.event_id = pairs.rid"""


def both_sides(ctes: str, left: str, right: str, columns: str) -> str:
    return (
        f"{ctes} SELECT 'left' AS side, {columns} FROM {left}"
        f" UNION ALL SELECT 'right', {columns} FROM {right}"
    )


def letters(length: int, words: list[str], start: int = 0) -> str:
    out = []
    for i in range(start, start + length):
        digit = f"(({words[i // 6]} // {52 ** (i % 6)}) % 52)"
        out.append(f"substr('{string.ascii_letters}', cast({digit} AS int) + 1, 1)")
    return f"concat({', '.join(out)})"


def with_keys(table: int) -> str:
    """CTEs idx (key_idx, n) and keyed (with key): one key per customer."""
    count = -(-KEY_SIZE // 6)
    number = (
        f"CASE WHEN key_idx < floor(n * {double(OVERLAP)}) THEN key_idx"
        f" ELSE xor(key_idx, {(table + 1) * 2**48}) END"
    )
    words = ", ".join(f"{mix('number', f'key-{i}')} AS w{i}" for i in range(count))
    key = letters(KEY_SIZE, [f"w{i}" for i in range(count)])
    return f"""WITH idx AS (SELECT c_custkey AS key_idx, count(*) OVER () AS n FROM customer),
pooled AS (SELECT key_idx, n, {number} AS number FROM idx),
worded AS (SELECT key_idx, n, {words} FROM pooled),
keyed AS (SELECT key_idx, n, {key} AS key FROM worded)"""


def synth(table: int, kind: str, sites: int = SITES) -> str:
    """A generated table: table, site, key, values; one key per customer."""
    low, high = max(RPK[0] // sites, 1), max(RPK[1] // sites, 1)
    if kind == "sliced":
        site = f"cast(least(key_idx // (n // {sites}), {sites - 1}) AS int)"
    else:
        site = f"cast(unnest(range({sites})) AS int)"
    if kind == "zipf":
        counted = "SELECT p.*, z.x AS rpk FROM placed p JOIN zipf z USING (key_idx)"
    else:
        u = uniform(mix("place", f"rpk{table}"))
        counted = f"SELECT *, cast(floor({low} + {u} * {high - low}) AS bigint) AS rpk FROM placed"
    names = [f"w{i}" for i in range(-(-VALUE_SIZE * len(VALUES) // 6))]
    words = ", ".join(
        f"{mix('xor(place, copy)', f'table{table}-record-{i}')} AS {w}" for i, w in enumerate(names)
    )
    values = ", ".join(
        f"{letters(VALUE_SIZE, names, VALUE_SIZE * i)} AS {c}" for i, c in enumerate(VALUES)
    )
    # Devroye's rejection with 64 tries; the chance that all fail is below 1e-20.
    rest = ZIPF - 1.0
    u, v = (uniform(mix("xor(b, attempt)", f"zipf-{name}", 12345)) for name in "uv")
    ratio = f"pow(1e0 + 1e0 / x, {double(rest)})"
    zipf = f"""
tries AS (SELECT key_idx, attempt, {v} AS v, floor(pow({u}, {double(-1.0 / rest)})) AS x
          FROM (SELECT key_idx, {mix("key_idx", "zipf", 12345)} AS b,
                       unnest(range(64)) AS attempt FROM idx)),
zipf AS (SELECT key_idx, cast(arg_min(x, attempt) AS bigint) AS x FROM tries
         WHERE v * x * ({ratio} - 1e0) / {double(2.0**rest - 1.0)} <= {ratio} / {double(2.0**rest)}
         GROUP BY key_idx),"""
    return f"""
SELECT * FROM ({with_keys(table)},
sited AS (SELECT key_idx, key, {mix("key_idx", "position")} AS position, {site} AS site FROM keyed),
placed AS (SELECT key_idx, key, site, {mix("xor(position, site)", "place")} AS place FROM sited),
{zipf if kind == "zipf" else ""}
counted AS ({counted}),
records AS (SELECT key, site, place, unnest(generate_series(1, rpk)) AS copy FROM counted),
filled AS (SELECT key, site, {words} FROM records)
SELECT cast({table} AS int) AS "table", site, key, {values} FROM filled)"""


def phases() -> str:
    """Four phases over the files of two generated tables at two sites."""

    def table(t: int) -> str:
        fields = "||".join(f"'\"{c}\":\"' || {c} || '\",' " for c in ("key", *VALUES))
        row = f"'{{' || {fields} || '\"site\":' || site || '}}'"
        return f"SELECT {row} AS id, key AS k FROM ({synth(t, 'uniform', 2)})"

    def value(side: str, name: str, suffix: str) -> str:
        return f"json_extract_string({side}, '$.{name}') AS {name}{suffix}"

    columns = [value("lid", c, "_1") for c in VALUES] + [value("rid", c, "_2") for c in VALUES]
    return f"{with_pairs(table(0), table(1), FRACTION, text_ids=True)} SELECT k AS key, {', '.join(columns)} FROM pairs"


def steps_of(weights: str, fraction: float) -> str:
    """CTE steps (weight, n, lo, hi): Poisson numbers by intervals of a uniform number."""
    reach = "12e0 * sqrt(mean) + 20e0"
    return f"""means AS (SELECT DISTINCT weight, {double(fraction)} * weight AS mean FROM {weights}),
grid AS (SELECT weight, mean, unnest(generate_series(
             cast(greatest(0e0, floor(mean - ({reach}))) AS bigint),
             cast(ceil(mean + {reach}) AS bigint))) AS n FROM means),
mass AS (SELECT weight, n, exp(n * ln(mean) - mean - lgamma(n + 1e0)) AS p FROM grid),
raised AS (SELECT weight, n,
             sum(p) OVER (PARTITION BY weight ORDER BY n ROWS UNBOUNDED PRECEDING) AS hi,
             sum(p) OVER (PARTITION BY weight) AS total,
             n = max(n) OVER (PARTITION BY weight) AS is_last FROM mass),
cdf AS (SELECT weight, n, CASE WHEN is_last THEN 1e0 ELSE hi / total END AS hi FROM raised),
steps AS (SELECT weight, n, hi,
            coalesce(lag(hi) OVER (PARTITION BY weight ORDER BY n), 0e0) AS lo FROM cdf)"""


def star(branches: list[tuple[str, str, str, str]], fraction: float) -> str:
    """customer in the middle; branches are (table, id, key, customer's key)."""
    ctes, joins, product, picks, meets, out = [], [], [], [], [], []
    for n, (table, id_, key, own) in enumerate(branches):
        order = mix("xor(b, 1)", f"index-{n}")
        ctes.append(
            f"n{n} AS (SELECT {key} AS k, count(*) AS w FROM {table} GROUP BY ALL),"
            f"x{n} AS (SELECT t.*, row_number() OVER (PARTITION BY {key} ORDER BY {order}, {id_})"
            f" AS slot FROM (SELECT *, {mix(id_, 'right')} AS b FROM {table}) t)"
        )
        joins.append(f"JOIN n{n} ON n{n}.k = m.{own}")
        product.append(f"n{n}.w")
        pick = f"floor({uniform(mix('xor(b, copy)', f'pick-{n}'))} * w{n})"
        picks.append(f"cast({pick} AS bigint) + 1 AS s{n}")
        meets.append(f"JOIN x{n} ON x{n}.{key} = p.{own} AND x{n}.slot = p.s{n}")
        out.append(f"x{n}.{id_}")
    weights = ", ".join(f"{w} AS w{n}" for n, w in enumerate(product))
    return f"""WITH {", ".join(ctes)},
m AS (SELECT c_custkey, c_nationkey, {mix("c_custkey", "middle")} AS b FROM customer),
w AS (SELECT m.*, {uniform("b")} AS u, {weights}, {" * ".join(product)} AS weight FROM m {" ".join(joins)}),
{steps_of("w", fraction)},
d AS (SELECT w.*, s.n AS copies FROM w JOIN steps s
      ON w.weight = s.weight AND w.u > s.lo AND w.u <= s.hi WHERE s.n > 0),
c AS (SELECT *, unnest(generate_series(1, copies)) AS copy FROM d),
p AS (SELECT *, {", ".join(picks)} FROM c)
SELECT p.c_custkey, p.c_nationkey, {", ".join(out)} FROM p {" ".join(meets)}"""


def index_pairs() -> str:
    pick = f"cast(floor({uniform(mix('xor(b, copy)', 'pick'))} * weight) AS bigint) + 1"
    order = mix("xor(b, 1)", "index")
    return f"""{with_draws(ORDERS, EVENTS, FRACTION)},
picks AS (SELECT id, k, {pick} AS slot FROM cl),
ranks AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY {order}, id) AS slot FROM br),
pairs AS (SELECT p.k, p.id AS lid, q.id AS rid FROM picks p JOIN ranks q
          ON p.k = q.k AND p.slot = q.slot)"""


def transfer_report() -> str:
    def sized(phase: str, table: str, data: str, site: str, columns: list[str]) -> str:
        size = " + ".join(f"coalesce(strlen(cast({c} AS varchar)), 0)" for c in columns)
        return (
            f"SELECT '{phase}' AS phase, '{table}' AS \"table\", cast({site} AS varchar) AS sender,"
            f" count(*) AS n_rows, cast(sum({size} + {len(columns)}) AS bigint) AS n_bytes"
            f" FROM {data} GROUP BY ALL"
        )

    at = f"cast(id % {SITES} AS int)"
    parts = []
    for name, rows, counts, draws, extra in (
        ("orders", "l", "lc", "dl", ["o_orderstatus", "o_orderpriority"]),
        ("events", "r", "rc", "dr", ["event_type"]),
    ):
        source = "orders o ON o.o_orderkey" if name == "orders" else "events e ON e.event_id"
        per_site = f"(SELECT {at} AS site, k, count(*) AS n FROM {rows} GROUP BY ALL)"
        full = f"(SELECT {at} AS site, t.k, t.id, {', '.join(extra)} FROM {rows} t JOIN {source} = t.id)"
        drawn = (
            f"(SELECT {at} AS site, t.k, t.id, {', '.join(extra)}, t.copies"
            f" FROM {draws} t JOIN {source} = t.id)"
        )
        parts += [
            sized("tables", name, full, "site", ["k", "id", *extra]),
            sized("site counts", name, per_site, "site", ["k", "n"]),
            sized("global counts", name, counts, "'coordinator'", ["k", "n"]),
            sized("samples", name, drawn, "site", ["k", "id", *extra, "copies"]),
        ]
    return with_draws(ORDERS, EVENTS, FRACTION) + " " + " UNION ALL ".join(parts)


def hot(table: str, id_: str, key: str) -> str:
    return f"SELECT {id_} AS id, CASE WHEN {id_} % 3 = 0 THEN 0 ELSE {key} END AS k FROM {table}"


def all_queries() -> dict[str, str]:
    draws = with_draws(ORDERS, EVENTS, FRACTION)
    pairs = with_pairs(ORDERS, EVENTS, FRACTION)
    key_columns = {
        "orders.o_custkey": ("orders", "o_custkey"),
        "events.user_id": ("events", "user_id"),
        "lineitem.l_partkey": ("lineitem", "l_partkey"),
        "lineitem.l_suppkey": ("lineitem", "l_suppkey"),
    }
    frequencies = " UNION ALL ".join(
        f"SELECT '{label}' AS source, {column} AS key, count(*) AS n FROM {table} GROUP BY {column}"
        for label, (table, column) in key_columns.items()
    )
    per_site = " UNION ALL ".join(
        f"SELECT '{table}' AS source, cast({id_} % {SITES} AS int) AS site, {column} AS key,"
        f" count(*) AS n FROM {table} GROUP BY ALL"
        for table, id_, column in (
            ("orders", "o_orderkey", "o_custkey"),
            ("events", "event_id", "user_id"),
        )
    )
    merged = " UNION ALL ".join(
        f"SELECT '{table}' AS source, {column} AS key, count(*) AS n FROM {table} GROUP BY ALL"
        for table, column in (("orders", "o_custkey"), ("events", "user_id"))
    )
    order_sites = f"SELECT cast(o_orderkey % {SITES} AS int) AS site, * FROM orders"
    event_sites = f"SELECT cast(event_id % {SITES} AS int) AS site, * FROM events"
    two = lambda kind: f"{synth(0, kind)} UNION ALL {synth(1, kind)}"
    keys = " UNION ALL ".join(
        f'SELECT * FROM ({with_keys(t)} SELECT cast({t} AS int) AS "table", key_idx, key FROM keyed)'
        for t in (0, 1)
    )
    sampled = orders_with_events(pairs)
    hot_key = with_pairs(
        hot("orders", "o_orderkey", "o_custkey"), hot("events", "event_id", "user_id"), HOT_FRACTION
    )
    of_hot_key = f"{hot_key} SELECT k AS key, lid AS o_orderkey, rid AS event_id FROM pairs"
    return {
        "key_frequencies": frequencies,
        "shared_key_counts": f"{draws} SELECT lc.k AS key, lc.n AS n_left, rc.n AS n_right"
        " FROM lc JOIN rc ON lc.k = rc.k",
        "weighted_rows": both_sides(draws, "wl", "wr", "id, k AS key, weight"),
        "poisson_cdf": f"{draws} SELECT weight, n, cast(floor(hi * 1e9 + 5e-1) AS bigint)"
        " AS cdf_e9 FROM cdf",
        "poisson_draws": both_sides(draws, "dl", "dr", "id, k AS key, weight, copies"),
        "expand_copies": both_sides(draws, "cl", "cr", "id, k AS key, copy"),
        "join_sample": sampled,
        "join_sample_mixed_types": sampled,
        "join_sample_hot_key": of_hot_key,
        "join_sample_hot_key_split": of_hot_key,
        "join_sample_indexed": orders_with_events(index_pairs()),
        "join_sample_indexed_split": orders_with_events(index_pairs()),
        "join_sample_chain": star(CHAIN, FRACTION),
        "join_sample_chain_split": star(CHAIN, FRACTION),
        "join_sample_star": star([*CHAIN, ("events", "event_id", "user_id", "c_custkey")], HOT_FRACTION),
        "site_scan": order_sites,
        "site_scan_events": event_sites,
        "site_key_frequencies": per_site,
        "merged_key_frequencies": merged,
        "site_samples": both_sides(
            draws, "dl", "dr", f"cast(id % {SITES} AS int) AS site, id, k AS key, copies"
        ),
        "union_sites": order_sites,
        "federated_join_sample": sampled,
        "federated_phases": phases(),
        "site_transfer_report": transfer_report(),
        "synth_keys": keys,
        "synth_uniform": two("uniform"),
        "synth_sliced": two("sliced"),
        "synth_zipf": two("zipf"),
        "synth_mixed": f"{synth(0, 'zipf')} UNION ALL {synth(1, 'uniform')}",
        "csv_roundtrip": f"""{pairs} SELECT o.*, e.* EXCLUDE (user_id) FROM pairs
            JOIN orders o ON o.o_orderkey = pairs.lid JOIN events e ON e.event_id = pairs.rid""",
    }
