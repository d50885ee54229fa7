"""DuckDB statements over the same tables, one per query that SQL can say.

Every statement is self-contained: it inlines the person, auction and bid views it reads.
"""

from auctionstream.sources import events

PERSON = """person AS (SELECT c_custkey AS id, c_name AS name,
    lower(c_mktsegment) || CAST(c_custkey AS VARCHAR) || '@example.com' AS emailAddress,
    lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS creditCard, n_name AS city,
    CASE c_nationkey % 6 WHEN 0 THEN 'AZ' WHEN 1 THEN 'CA' WHEN 2 THEN 'ID' WHEN 3 THEN 'OR' WHEN 4 THEN 'WA'
      ELSE 'WY' END AS state,
    TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 720 AS INT)) AS dateTime, c_mktsegment AS extra
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
AUCTION = """auction AS (SELECT o_orderkey AS id, o_orderpriority AS itemName, o_orderstatus AS description,
    CAST(floor(o_totalprice) AS BIGINT) AS initialBid, CAST(floor(o_totalprice * 2) AS BIGINT) AS reserve,
    TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 720 AS INT)) AS dateTime,
    TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 720 + 240 AS INT)) AS expires,
    o_custkey AS seller, 10 + o_orderkey % 5 AS category, o_orderstatus AS extra
  FROM orders)"""
BID = """bid AS (SELECT event_id AS id,
    CASE WHEN event_id % 4 = 0 THEN event_id % 7 ELSE event_id * 7919 % (SELECT max(o_orderkey) + 1 FROM orders) END AS auction,
    user_id AS bidder,
    CAST(floor(value * value * 100) AS BIGINT) AS price, event_type AS channel,
    'https://www.example.com/' || event_type || '/u' || CAST(user_id AS VARCHAR) || '/e'
      || CAST(event_id % 7 AS VARCHAR) || '/item.htm?query=1'
      || CASE WHEN event_id % 10 > 0 THEN '&channel_id=' || CAST(user_id AS VARCHAR) ELSE '' END AS url,
    ts AS dateTime, props AS extra
  FROM events)"""
VIEWS = {"person": PERSON, "auction": AUCTION, "bid": BID}

REPORT = """count(*) AS total_bids,
    count(*) FILTER (WHERE price < 10000) AS rank1_bids,
    count(*) FILTER (WHERE price >= 10000 AND price < 1000000) AS rank2_bids,
    count(*) FILTER (WHERE price >= 1000000) AS rank3_bids,
    count(DISTINCT bidder) AS total_bidders,
    count(DISTINCT bidder) FILTER (WHERE price < 10000) AS rank1_bidders,
    count(DISTINCT bidder) FILTER (WHERE price >= 10000 AND price < 1000000) AS rank2_bidders,
    count(DISTINCT bidder) FILTER (WHERE price >= 1000000) AS rank3_bidders,
    count(DISTINCT auction) AS total_auctions,
    count(DISTINCT auction) FILTER (WHERE price < 10000) AS rank1_auctions,
    count(DISTINCT auction) FILTER (WHERE price >= 10000 AND price < 1000000) AS rank2_auctions,
    count(DISTINCT auction) FILTER (WHERE price >= 1000000) AS rank3_auctions"""
STATISTICS = """count(*) AS total_bids,
    count(*) FILTER (WHERE price < 10000) AS rank1_bids,
    count(*) FILTER (WHERE price >= 10000 AND price < 1000000) AS rank2_bids,
    count(*) FILTER (WHERE price >= 1000000) AS rank3_bids,
    min(price) AS min_price, max(price) AS max_price,
    CAST(sum(price) // count(price) AS BIGINT) AS avg_price, CAST(sum(price) AS BIGINT) AS sum_price"""
EURO = "CAST(0.908 * price AS DECIMAL(23,3))"
WIDE_BID = "auction, bidder, price, channel, url, B.dateTime AS bid_dateTime, B.extra AS bid_extra"
WIDE_AUCTION = """itemName, description, initialBid, reserve, A.dateTime AS auction_dateTime, expires, seller,
    category, A.extra AS auction_extra"""


def _with(views: str, body: str, ctes: tuple[str, ...] = (), recursive: bool = False) -> str:
    parts = [VIEWS[v] for v in views.split()] + list(ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def bucket(size: str, ts: str = "dateTime") -> str:
    """Start of the window, aligned to 1970 as Spark aligns it."""
    return f"time_bucket(INTERVAL '{size}', {ts}, TIMESTAMP '1970-01-01')"


def hop_rows(size: str, slide: str, copies: int) -> str:
    """CTE: one row per bid and hopping window."""
    start = f"{bucket(slide)} - k * INTERVAL '{slide}'"
    return f"""hops AS (SELECT auction, price, {start} AS starttime, {start} + INTERVAL '{size}' AS endtime
  FROM bid, generate_series(0, {copies - 1}) AS g(k))"""


def session_rows(gap: str) -> tuple[str, str]:
    return (
        f"""gaps AS (SELECT bidder, dateTime, CASE WHEN dateTime - lag(dateTime) OVER w > INTERVAL '{gap}'
    THEN 1 ELSE 0 END AS fresh FROM bid WINDOW w AS (PARTITION BY bidder ORDER BY dateTime))""",
        """numbered AS (SELECT bidder, dateTime, sum(fresh) OVER (PARTITION BY bidder ORDER BY dateTime
    ROWS UNBOUNDED PRECEDING) AS nr FROM gaps)""",
    )


WINNERS = """offers AS (SELECT A.*, B.auction, B.bidder, B.price, B.dateTime AS bid_dateTime, B.extra AS bid_extra
  FROM auction A JOIN bid B ON A.id = B.auction AND B.dateTime BETWEEN A.dateTime AND A.expires),
winners AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id
    ORDER BY price DESC, bid_dateTime, bidder) AS rn FROM offers) WHERE rn = 1)"""


def batch(tumble: str, day: str, size: str, slide: str, copies: int, gap: str) -> dict[str, str]:
    """The statements of the relational queries for the given durations."""
    return {
        "q0": _with("bid", "SELECT auction, bidder, price, dateTime, extra FROM bid"),
        "q1": _with("bid", f"SELECT auction, bidder, {EURO} AS price, dateTime, extra FROM bid"),
        "q2": _with("bid", "SELECT auction, price FROM bid WHERE auction % 123 = 0"),
        "q3": _with("person auction", """SELECT P.name, P.city, P.state, A.id FROM auction A JOIN person P
  ON A.seller = P.id WHERE A.category = 10 AND (P.state = 'OR' OR P.state = 'ID' OR P.state = 'CA')"""),
        "q4": _with("auction bid", """SELECT category, CAST(sum(final) // count(final) AS BIGINT) AS final
FROM (SELECT max(B.price) AS final, A.category FROM auction A JOIN bid B
  ON A.id = B.auction AND B.dateTime BETWEEN A.dateTime AND A.expires GROUP BY A.id, A.category)
GROUP BY category"""),
        "q5": _with("bid", """SELECT C.auction, C.num FROM counts C JOIN most M
  ON C.starttime = M.starttime AND C.endtime = M.endtime AND C.num >= M.maxn""", (
            hop_rows(size, slide, copies),
            "counts AS (SELECT auction, starttime, endtime, count(*) AS num FROM hops GROUP BY ALL)",
            "most AS (SELECT starttime, endtime, max(num) AS maxn FROM counts GROUP BY ALL)",
        )),
        "q6": _with("auction bid", """SELECT CAST(seller AS VARCHAR) AS seller,
  CAST(sum(price) OVER w // count(price) OVER w AS BIGINT) AS avg_price FROM winners
WINDOW w AS (PARTITION BY seller ORDER BY bid_dateTime, id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)""", (WINNERS,)),
        "q7": _with("bid", f"""SELECT B.auction, B.price, B.bidder, B.dateTime, B.extra FROM bid B JOIN (
  SELECT max(price) AS maxprice, {bucket(tumble)} + INTERVAL '{tumble}' AS endtime FROM bid GROUP BY endtime) M
ON B.price = M.maxprice AND B.dateTime BETWEEN M.endtime - INTERVAL '{tumble}' AND M.endtime"""),
        "q8": _with("person auction", f"""SELECT P.id, P.name, P.stime FROM
  (SELECT DISTINCT id, name, {bucket(day)} AS stime FROM person) P JOIN
  (SELECT DISTINCT seller, {bucket(day)} AS stime FROM auction) A ON P.id = A.seller AND P.stime = A.stime"""),
        "q9": _with("auction bid", "SELECT * FROM winners", (WINNERS,)),
        "q10": _with("bid", """SELECT auction, bidder, price, dateTime, extra,
  strftime(dateTime, '%Y-%m-%d') AS dt, strftime(dateTime, '%H:%M') AS hm FROM bid"""),
        "q11": _with("bid", f"""SELECT bidder, count(*) AS bid_count, min(dateTime) AS starttime,
  max(dateTime) + INTERVAL '{gap}' AS endtime FROM numbered GROUP BY bidder, nr""", session_rows(gap)),
        "q12": _with("bid", "SELECT bidder, count(*) AS bid_count FROM bid GROUP BY bidder"),
        "q13": _with("bid", """SELECT auction, bidder, price, dateTime, CAST(S.key AS VARCHAR) AS value
FROM bid JOIN (SELECT range AS key FROM range(10000)) S ON auction % 10000 = S.key"""),
        "q14": _with("bid", f"""SELECT auction, bidder, {EURO} AS price,
  CASE WHEN hour(dateTime) >= 8 AND hour(dateTime) <= 18 THEN 'dayTime'
       WHEN hour(dateTime) <= 6 OR hour(dateTime) >= 20 THEN 'nightTime' ELSE 'otherTime' END AS bidTimeType,
  dateTime, extra, length(extra) - length(replace(extra, 'c', '')) AS c_counts
FROM bid WHERE {EURO} > 1000000 AND {EURO} < 50000000"""),
        "q15": _with("bid", f"SELECT strftime(dateTime, '%Y-%m-%d') AS day, {REPORT} FROM bid GROUP BY day"),
        "q16": _with("bid", f"""SELECT channel, strftime(dateTime, '%Y-%m-%d') AS day,
  max(strftime(dateTime, '%H:%M')) AS minute, {REPORT} FROM bid GROUP BY channel, day"""),
        "q17": _with("bid", f"""SELECT auction, strftime(dateTime, '%Y-%m-%d') AS day, {STATISTICS}
FROM bid GROUP BY auction, day"""),
        "q18": _with("bid", """SELECT auction, bidder, price, channel, url, dateTime, extra FROM (
  SELECT *, row_number() OVER (PARTITION BY bidder, auction
    ORDER BY dateTime DESC, price DESC, channel DESC, url DESC, extra DESC) AS rn FROM bid) WHERE rn = 1"""),
        "q19": _with("bid", """SELECT auction, bidder, price, channel, url, dateTime, extra, rank_number FROM (
  SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, dateTime) AS rank_number FROM bid)
WHERE rank_number <= 10"""),
        "q20": _with("auction bid", f"""SELECT {WIDE_BID}, {WIDE_AUCTION} FROM bid B JOIN auction A
  ON B.auction = A.id WHERE A.category = 10"""),
        "q20_mod": _with("auction bid", f"""SELECT B.id AS bid_id, {WIDE_BID}, {WIDE_AUCTION} FROM bid B
  JOIN auction A ON B.auction = A.id WHERE A.category = 10"""),
        "q20_bidder": _with("auction bid", """SELECT B.bidder, A.id AS auction_id FROM bid B JOIN auction A
  ON B.bidder = A.id WHERE A.category = 10"""),
        "q20_bidder_full": _with("auction bid", """SELECT B.auction, B.bidder, B.price, B.dateTime,
  A.id AS auction_id FROM bid B JOIN auction A ON B.bidder = A.id WHERE A.category = 10"""),
        "q20_price": _with("auction bid", """SELECT B.price, A.id AS auction_id FROM bid B JOIN auction A
  ON B.price = A.id WHERE A.category = 10"""),
        "q21": _with("bid", r"""SELECT * FROM (SELECT auction, bidder, price, channel,
  CASE lower(channel) WHEN 'apple' THEN '0' WHEN 'google' THEN '1' WHEN 'facebook' THEN '2' WHEN 'baidu' THEN '3'
    ELSE CASE WHEN regexp_matches(url, '(&|^)channel_id=([^&]*)')
      THEN regexp_extract(url, '(&|^)channel_id=([^&]*)', 2) END END AS channel_id FROM bid)
WHERE channel_id IS NOT NULL"""),
        "q22": _with("bid", """SELECT auction, bidder, price, channel, string_split(url, '/')[4] AS dir1,
  string_split(url, '/')[5] AS dir2, string_split(url, '/')[6] AS dir3 FROM bid"""),
        "q23": _with("person auction bid", """SELECT bidder, price, channel, url, B.extra AS bid_extra,
  P.id AS person_id, name, emailAddress, creditCard, city, state, P.extra AS person_extra, itemName, description,
  initialBid, reserve, A.dateTime AS auction_dateTime, expires, seller, category, A.extra AS auction_extra
FROM bid B JOIN person P ON P.id = B.bidder JOIN auction A ON A.seller = B.bidder"""),
    }


# ---- generator: the event table's ids are the event numbers; group size 7, delay probability 0.1

PRIME = 2147483647


def _draw(number: str, slot: int) -> str:
    linear = f"(({number} % {PRIME} * 48271 + {number} // {PRIME} * 69621 + 1) % {PRIME})"
    return f"(xor({linear}, {linear} >> 15) * 1583458089 % {PRIME} * {pow(16807, slot, PRIME)} % {PRIME})"


def _draws(number: str, slots, prefix: str = "d") -> str:
    return ", ".join(f"{_draw(number, s)} AS {prefix}{s}" for s in slots)


def _filler(length: int, separator: str = "") -> str:
    state, letters = 12345, []
    for _ in range(length):
        state = (state * 1103515245 + 12345) % 2147483648
        value = state // 256
        letters.append(separator if separator and value % 13 == 0 else chr(97 + value // 13 % 26))
    return "".join(letters)


def _text(draws: list[str], limit: int, separator: str = " ") -> str:
    pool = _filler(2048, separator)
    pieces = " || ".join(f"substr('{pool}', 1 + {d} % 2032, 16)" for d in draws[1:])
    return f"trim(substr({pieces}, 1, 3 + {draws[0]} % {limit - 3}))"


def _pick(values: list[str], draw: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[{draw} % {len(values)} + 1]"


def _price(draw: str) -> str:
    return f"CAST(round(pow(10e0, {draw} / {PRIME}e0 * 6e0) * 100e0) AS BIGINT)"


def _extra(average: int, size_draw: str, start_draw: str) -> str:
    pool = _filler(max(2048, 4 * average))
    delta = "CAST(round(rest * 0.2e0) AS BIGINT)"
    size = f"rest - {delta} + CASE WHEN {delta} = 0 THEN 0 ELSE {size_draw} % greatest(2 * {delta}, 1) END"
    return f"CASE WHEN rest < 0 THEN '' ELSE substr('{pool}', 1 + {start_draw} % {len(pool) - 2 * average}, {size}) END"


def _identity(number: str = "event_id + 1", group: int = 7) -> str:
    return f"""ids AS (SELECT event_id AS k, {number} AS n, n - n % {group} + n * 953 % {group} AS adjusted,
    1 + adjusted AS id, id // 50 AS epoch, id % 50 AS rest_id, 1700000000000 + adjusted * 100 // 1000 AS millis,
    CASE WHEN rest_id < 1 THEN 0 WHEN rest_id < 4 THEN 1 ELSE 2 END AS kind, epoch AS last_person,
    CASE WHEN rest_id < 1 THEN epoch * 3 - 1 ELSE epoch * 3 + least(rest_id - 1, 2) END AS last_auction,
    make_timestamp(millis * 1000) AS dateTime,
    make_timestamp((1700000000000 + (n - n % {group}) * 100 // 1000) * 1000) AS lowWaterMark,
    make_timestamp((1700000000000 + n * 100 // 1000 + CASE WHEN kind > 0 AND {_draw('id', 30)} / {PRIME}e0 < 0.1e0
      THEN 60000 + {_draw('id', 31)} % 180001 ELSE 0 END) * 1000) AS arrival
  FROM events)"""


def _any_person(draw: str) -> str:
    active = "least(last_person + 1, 1000)"
    return f"last_person + 1 - {active} + {draw} % ({active} + 10)"


def _generated() -> dict[str, str]:
    text = {
        "mail": _text(["d3", "d4"], 7), "host": _text(["d5", "d6"], 5),
        "item": _text(["d1", "d2", "d3"], 20), "description": _text([f"d{i}" for i in range(5, 13)], 100),
    }
    card = " || ' ' || ".join(f"lpad(CAST(d{i} % 10000 AS VARCHAR), 4, '0')" for i in range(7, 11))
    person = (
        f"drawn AS (SELECT *, {_draws('id', range(1, 15))} FROM ids WHERE kind = 0)",
        f"""made AS (SELECT *, 1000 + last_person AS person_id,
    {_pick(events.FIRST_NAMES, 'd1')} || ' ' ||
      {_pick(events.LAST_NAMES, 'd2')} AS name,
    {text['mail']} || '@' || {text['host']} || '.com' AS emailAddress, {card} AS creditCard,
    {_pick(events.CITIES, 'd11')} AS city,
    {_pick(events.STATES, 'd12')} AS state FROM drawn)""",
        """sized AS (SELECT *, 192 - length(name) - length(emailAddress) - length(creditCard) - length(city)
    - length(state) AS rest FROM made)""",
        f"""person AS (SELECT person_id AS id, name, emailAddress, creditCard, city, state, dateTime,
    {_extra(200, 'd13', 'd14')} AS extra FROM sized)""",
    )
    horizon = "((adjusted + 1666) * 100 // 1000 - adjusted * 100 // 1000)"
    auction = (
        f"drawn AS (SELECT *, {_draws('id', range(1, 24))} FROM ids WHERE kind = 1)",
        f"""made AS (SELECT *, 1000 + last_auction AS auction_id, {text['item']} AS itemName,
    {text['description']} AS description, {_price('d16')} AS initialBid FROM drawn)""",
        "sized AS (SELECT *, 452 - length(itemName) - length(description) AS rest FROM made)",
        f"""auction AS (SELECT auction_id AS id, itemName, description, initialBid,
    initialBid + {_price('d17')} AS reserve, dateTime,
    make_timestamp((millis + 1 + d18 % greatest(2 * {horizon}, 1)) * 1000) AS expires,
    1000 + CASE WHEN d19 % 4 > 0 THEN last_person - last_person % 100 ELSE {_any_person('d20')} END AS seller,
    10 + d21 % 5 AS category, {_extra(500, 'd22', 'd23')} AS extra FROM sized)""",
    )
    oldest = "greatest(last_auction - 100, 0)"
    dirs = " || '/' || ".join(_text([f"c{s}", f"c{s + 1}"], 5, "_") for s in (50, 52, 54))
    bid = (
        f"""drawn AS (SELECT *, {_draws('id', range(1, 11))},
    CASE WHEN d6 % 2 > 0 THEN 10000 + d7 % 4 ELSE d8 % 10000 END AS nr FROM ids WHERE kind = 2)""",
        f"made AS (SELECT *, {_draws('nr', range(50, 58), 'c')}, 68 AS rest FROM drawn)",
        f"""bid AS (SELECT id,
    1000 + CASE WHEN d1 % 2 > 0 THEN last_auction - last_auction % 100
      ELSE {oldest} + d2 % (last_auction - {oldest} + 11) END AS auction,
    2000 + CASE WHEN d3 % 4 > 0 THEN last_person - last_person % 100 + 1 ELSE {_any_person('d4')} END AS bidder,
    {_price('d5')} AS price,
    CASE WHEN nr < 10000 THEN 'channel-' || nr ELSE {_pick(events.HOT_CHANNELS, 'nr')} END AS channel,
    'https://www.example.com/' || {dirs} || '/item.htm?query=1' ||
      CASE WHEN nr < 10000 AND c56 % 10 > 0 THEN '&channel_id=' || c57 ELSE '' END AS url,
    dateTime, {_extra(100, 'd9', 'd10')} AS extra FROM made)""",
    )
    ids = _identity()
    line = "((SELECT count(*) FROM events) // 4)"
    renamed = [part.replace("drawn", "b_drawn").replace("FROM made", "FROM b_made").replace("made AS", "b_made AS") for part in bid]
    typed_bid = "SELECT id, auction, bidder, price, dateTime FROM bid"
    return {
        "gen_identity": f"WITH {ids} SELECT k, id, kind AS event_type, last_person, last_auction, dateTime, lowWaterMark, arrival FROM ids",
        "gen_split": f"""WITH lines AS (SELECT event_id AS k, least(event_id // {line}, 3) * {line} AS skipped FROM events)
SELECT k, 1 + skipped + k - skipped + 1 AS id,
  make_timestamp((1700000000000 + (k - skipped + 1) * 400 // 1000) * 1000) AS dateTime FROM lines""",
        "gen_person": f"WITH {', '.join((ids, *person))} SELECT * FROM person",
        "gen_auction": f"WITH {', '.join((ids, *auction))} SELECT * FROM auction",
        "gen_bid": f"WITH {', '.join((ids, *bid))} SELECT * FROM bid",
        "src_typed": f"WITH {', '.join((ids, *person))} SELECT * FROM person",
        "src_typed_bidmod": f"WITH {', '.join((ids, *bid))} {typed_bid}",
        "src_v2": f"WITH {', '.join((ids, *bid))} {typed_bid}",
        "src_union": f"""WITH {', '.join((ids, *renamed))}
SELECT kind AS event_type, CASE WHEN kind = 0 THEN 1000 + last_person END AS person_id,
  CASE WHEN kind = 1 THEN 1000 + last_auction END AS auction_id, bid.auction AS bid_auction,
  bid.bidder AS bid_bidder, bid.price AS bid_price, ids.dateTime, arrival, lowWaterMark
FROM ids LEFT JOIN bid ON ids.kind = 2 AND ids.id = bid.id""",
    }


def _heads(bid: str, bid_name: str) -> str:
    cut = "date_trunc('milliseconds', dateTime)" if bid_name == "topic" else "dateTime"
    return f"""SELECT 'person' AS entity, id, dateTime, extra FROM person UNION ALL
SELECT 'auction' AS entity, id, dateTime, extra FROM auction UNION ALL
SELECT '{bid_name}' AS entity, {bid} AS id, {cut} AS dateTime, extra FROM bid"""


def sources(relational: dict[str, str]) -> dict[str, str]:
    everything, cut = "person auction bid", "date_trunc('milliseconds', dateTime) AS dateTime"
    return _generated() | {
        "src_views": _with(everything, _heads("auction", "bid")),
        "src_views_u": _with(everything, _heads("id", "bid_modified")),
        "snk_multi": _with(everything, _heads("auction", "bid")),
        "src_kafka": _with("bid", f"SELECT auction, bidder, price, channel, url, {cut}, extra FROM bid"),
        "src_upsert": _with("bid", f"SELECT id, auction, bidder, price, channel, url, {cut}, extra FROM bid"),
        "snk_upsert": _with("bid", """SELECT id, bidder, price FROM (SELECT *, row_number() OVER (PARTITION BY bidder
  ORDER BY id DESC) AS rn FROM bid) WHERE rn = 1"""),
        "snk_kafka": _with(everything, """SELECT 0 AS partition, NULL AS seller, NULL AS price FROM person UNION ALL
SELECT 1, seller, NULL FROM auction UNION ALL SELECT 2, NULL, price FROM bid"""),
        "snk_null": _with("bid", "SELECT count(*) AS written FROM bid"),
        "snk_part": _with("bid", f"""SELECT auction, bidder, price, {cut}, extra,
  strftime(bid.dateTime, '%Y-%m-%d') AS dt, strftime({bucket('6 hours', 'bid.dateTime')}, '%H:%M') AS hm FROM bid"""),
        "src_csv": relational["q13"],
        "src_side": _with("bid", """SELECT range AS key, CAST(range AS VARCHAR) AS value FROM range(10000)
WHERE range IN (SELECT auction % 10000 FROM bid)"""),
    }


def streams(relational: dict[str, str], tumble: str, day: str, size: str, slide: str, copies: int, gap: str) -> dict[str, str]:
    """Append mode shows the windows that the final watermark has closed; the rest equals the batch form."""
    closed = "endtime <= (SELECT max(dateTime) FROM bid) - INTERVAL '4 seconds'"
    hops = hop_rows(size, slide, copies)
    start = bucket(tumble)
    both = """least((SELECT max(dateTime) FROM bid), (SELECT max(dateTime) FROM auction)) - INTERVAL '4 seconds'"""
    counts = "counts AS (SELECT auction, starttime, endtime, count(*) AS num FROM hops GROUP BY ALL)"
    windows = f"SELECT {start} AS starttime, {start} + INTERVAL '{tumble}' AS endtime"
    closed_counts = _with("bid", f"SELECT * FROM ({windows}, count(*) AS bid_count FROM bid GROUP BY 1, 2) WHERE {closed}")
    same = {
        "st_join": "q20", "st_join_q3": "q3", "st_join_q23": "q23", "st_lookup": "q13", "st_upd_agg": "q17",
        "st_upd_agg_q15": "q15", "st_upd_agg_q16": "q16", "st_dedup_last": "q18", "st_topn": "q19",
        "st_join_agg": "q4", "st_procwin": "q12",
    }
    return {name: relational[query] for name, query in same.items()} | {
        "st_wm": closed_counts,
        "st_resume": closed_counts,
        "st_tumble": _with("bid", f"SELECT * FROM ({windows}, max(price) AS maxprice FROM bid GROUP BY 1, 2) WHERE {closed}"),
        "st_hop": _with("bid", f"SELECT * FROM counts WHERE {closed}", (hops, counts)),
        "st_session": _with("bid", f"""SELECT * FROM (SELECT bidder, count(*) AS bid_count, min(dateTime) AS starttime,
  max(dateTime) + INTERVAL '{gap}' AS endtime FROM numbered GROUP BY bidder, nr) WHERE {closed}""", session_rows(gap)),
        "st_chain": _with("bid", f"""SELECT C.auction, C.num, C.starttime, C.endtime FROM counts C JOIN
  (SELECT endtime AS e, max(num) AS maxn FROM counts GROUP BY endtime) M ON C.endtime = M.e AND C.num >= M.maxn
WHERE {closed}""", (hops, counts)),
        "st_wjoin": _with("bid", f"""SELECT B.auction, B.price, B.bidder, B.dateTime, B.extra FROM bid B JOIN (
  SELECT * FROM (SELECT max(price) AS maxprice, {start} + INTERVAL '{tumble}' AS endtime FROM bid GROUP BY endtime)
  WHERE {closed}) M ON B.price = M.maxprice AND B.dateTime BETWEEN M.endtime - INTERVAL '{tumble}' AND M.endtime"""),
        "st_wjoin_q8": _with("person auction", f"""SELECT P.id, P.name, P.stime FROM
  (SELECT DISTINCT id, name, {bucket(day)} AS stime FROM person) P JOIN
  (SELECT DISTINCT seller, {bucket(day)} AS stime FROM auction) A ON P.id = A.seller AND P.stime = A.stime
WHERE P.stime + INTERVAL '{day}' <= least((SELECT max(dateTime) FROM person), (SELECT max(dateTime) FROM auction))
  - INTERVAL '4 seconds'"""),
        "st_ijoin": _with("auction bid", """SELECT A.id, category, bidder, price, B.dateTime AS bid_dateTime
FROM auction A JOIN bid B ON A.id = B.auction AND B.dateTime BETWEEN A.dateTime AND A.expires"""),
        "st_final": _with("auction bid", f"""SELECT id, seller, expires, bidder, price, bid_dateTime FROM winners
WHERE expires <= {both} - INTERVAL '10 days'""", (WINNERS,)),
        "st_unique": _with("bid", "SELECT id, auction, price, dateTime FROM bid"),
        "st_late": _with("bid", f"""SELECT * FROM ({windows}, count(*) AS bid_count FROM arrived JOIN marks USING (part)
WHERE {start} + INTERVAL '{tumble}' > coalesce(late_mark, TIMESTAMP '1970-01-01') GROUP BY 1, 2) WHERE {closed}""", (
            f"""arrived AS (SELECT *, {bucket('5 days', "dateTime + to_days(CAST(CASE WHEN id % 10 = 0 THEN id % 8 ELSE 0 END AS INT))")} AS part
  FROM bid)""",
            """marks AS (SELECT part, lag(mark) OVER (ORDER BY part) AS late_mark FROM (SELECT part,
    max(max(dateTime)) OVER (ORDER BY part) - INTERVAL '4 seconds' AS mark FROM arrived GROUP BY part))""",
        )),
    }


# ---- row patterns, per bidder; each bidder's rows are numbered by time


def _pattern_rows(stream: bool) -> str:
    passed = " WHERE dateTime <= (SELECT max(dateTime) FROM bid) - INTERVAL '4 seconds'" if stream else ""
    return f"""r AS (SELECT bidder, dateTime, price, row_number() OVER (PARTITION BY bidder ORDER BY dateTime, id) AS i,
    sum(price - 10000) OVER (PARTITION BY bidder ORDER BY dateTime, id ROWS UNBOUNDED PRECEDING) AS s
  FROM bid{passed})"""


# Falling runs numbered per bidder, with their last two prices and the row after them.
FALLS = """f AS (SELECT *, CASE WHEN price < lag(price) OVER w THEN 0 ELSE 1 END AS fresh FROM r
    WINDOW w AS (PARTITION BY bidder ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY bidder ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
runs AS (SELECT bidder, run, count(*) AS n, min(dateTime) AS start_tstamp, max(dateTime) AS bottom_tstamp,
    arg_max(price, -i) AS first_price, list(price ORDER BY i)[-2] AS second_last FROM g GROUP BY bidder, run)"""
FALL_MATCHES = """SELECT a.bidder, a.start_tstamp, a.bottom_tstamp, b.start_tstamp AS end_tstamp
FROM runs a JOIN runs b ON a.bidder = b.bidder AND b.run = a.run + 1
WHERE a.n >= 3 AND b.first_price > a.second_last"""
# From every low row to the row that lifts the average to the limit; j is null where none does.
LOW = """low AS (SELECT a.bidder, a.i, min(b.i) AS j FROM r a LEFT JOIN r b ON a.bidder = b.bidder AND b.i > a.i
    AND b.s - a.s + a.price - 10000 >= 0 WHERE a.price < 10000 GROUP BY a.bidder, a.i)"""
# From every row to the first price at or below its own minus 50; only a lower one within a day counts.
DROPS = """reach AS (SELECT a.bidder, a.i, min(b.i) AS j FROM r a LEFT JOIN r b ON a.bidder = b.bidder AND b.i > a.i
    AND b.price <= a.price - 50 GROUP BY a.bidder, a.i),
drops AS (SELECT e.bidder, e.i, e.j, c.dateTime AS drop_time, a.price - c.price AS drop_diff, a.dateTime AS begun
  FROM reach e JOIN r a ON e.bidder = a.bidder AND e.i = a.i LEFT JOIN r c ON e.bidder = c.bidder AND e.j = c.i)"""
GOOD_DROPS = "good AS (SELECT * FROM drops WHERE drop_diff > 50 AND drop_time - begun < INTERVAL '1 day')"
GOOD_LOW = "good AS (SELECT * FROM low WHERE j IS NOT NULL)"
# Left to right, the next match starts behind the last one.
CHAIN = """chain AS (SELECT bidder, min(i) AS i FROM good GROUP BY bidder UNION ALL
  SELECT chain.bidder, (SELECT min(n.i) FROM good n WHERE n.bidder = chain.bidder AND n.i > g.j) AS i
  FROM chain JOIN good g ON chain.bidder = g.bidder AND chain.i = g.i WHERE chain.i IS NOT NULL),
picked AS (SELECT good.* FROM good JOIN chain USING (bidder, i))"""


def _low_measures(source: str, where: str = "") -> str:
    return f"""SELECT p.bidder, a.dateTime AS start_tstamp, b.dateTime AS end_tstamp,
  CAST((b.s - a.s + a.price - 10000 + 10000 * (p.j - p.i)) // (p.j - p.i) AS BIGINT) AS avg_price
FROM {source} p JOIN r a ON p.bidder = a.bidder AND p.i = a.i JOIN r b ON p.bidder = b.bidder AND p.j - 1 = b.i {where}"""


def patterns() -> dict[str, str]:
    """On streams only rows up to the watermark count, and an attempt that is still open holds back the
    later ones of its bidder."""
    out = {}
    for prefix, stream in (("", False), ("st_", True)):
        rows = _pattern_rows(stream)
        open_low = "p.i < coalesce((SELECT min(o.i) FROM low o WHERE o.bidder = p.bidder AND o.j IS NULL), 1000000000)"
        held = f"WHERE {open_low}" if stream else ""
        out[f"{prefix}cep0"] = _with("bid", FALL_MATCHES, (rows, FALLS))
        out[f"{prefix}cep2"] = _with("bid", _low_measures("good", held), (rows, LOW, GOOD_LOW))
        out[f"{prefix}cep1"] = _with("bid", _low_measures("picked", held), (rows, LOW, GOOD_LOW, CHAIN), True)
        undecided = """WHERE p.i < coalesce((SELECT min(o.i) FROM drops o WHERE o.bidder = p.bidder AND o.j IS NULL
    AND (SELECT max(dateTime) FROM bid) - INTERVAL '4 seconds' - o.begun < INTERVAL '1 day'
    AND NOT EXISTS (SELECT 1 FROM picked q WHERE q.bidder = o.bidder AND q.i < o.i AND o.i <= q.j)), 1000000000)"""
        body = f"SELECT p.bidder, p.drop_time, p.drop_diff FROM picked p {undecided if stream else ''}"
        out[f"{prefix}cep3"] = _with("bid", body, (rows, DROPS, GOOD_DROPS, CHAIN), True)
    out["match_rows"] = out["cep0"]
    return out


# ---- single rules and functions


def rules(generated: dict[str, str], tumble: str) -> dict[str, str]:
    parts = {
        "gen_time": ("gen_split", "k, dateTime"),
        "gen_ooo": ("gen_identity", "k, id"),
        "gen_wm": ("gen_identity", "k, lowWaterMark"),
        "gen_delay": ("gen_identity", "k, event_type, arrival"),
        "gen_auction_id": ("gen_identity", "k, last_auction"),
        "gen_person_id": ("gen_identity", "k, last_person"),
        "gen_auction_pick": ("gen_bid", "id, auction"),
        "gen_auction_len": ("gen_auction", "id, dateTime, expires"),
        "gen_bidder_shift": ("gen_bid", "id, bidder"),
        "gen_channel": ("gen_bid", "id, channel, url"),
        "gen_price": ("gen_bid", "id, price"),
        "gen_string": ("gen_auction", "id, itemName, description"),
        "gen_extra": ("gen_bid", "id, extra"),
    }
    start = bucket(tumble)
    out = {name: f"SELECT {columns} FROM ({generated[query]})" for name, (query, columns) in parts.items()}
    return out | {
        "gen_mix": f"SELECT event_type, count(*) AS events FROM ({generated['gen_identity']}) GROUP BY event_type",
        "gen_start": f"WITH {_identity('event_id + 1001')} SELECT k, id FROM ids",
        "gen_size": """SELECT n AS events, CAST(n // 50 * 200 + n * 3 // 50 * 500 + n * 46 // 50 * 100 AS BIGINT)
  AS estimated_bytes FROM (SELECT count(*) AS n FROM events)""",
        "f_mod": _with("bid", "SELECT id, auction % 123 AS remainder FROM bid"),
        "f_datefmt": _with("bid", "SELECT id, strftime(dateTime, '%Y-%m-%d') AS dt, strftime(dateTime, '%H:%M') AS hm FROM bid"),
        "f_hour": _with("bid", "SELECT id, hour(dateTime) AS hour FROM bid"),
        "f_lower": _with("bid", "SELECT id, lower(channel) AS lowered FROM bid"),
        "f_regex": _with("bid", """SELECT id, CASE WHEN regexp_matches(url, '(&|^)channel_id=([^&]*)')
  THEN regexp_extract(url, '(&|^)channel_id=([^&]*)', 2) END AS channel_id FROM bid"""),
        "f_split": _with("bid", "SELECT id, string_split(url, '/')[4] AS dir1, string_split(url, '/')[10] AS none FROM bid"),
        "f_case": _with("bid", """SELECT id, CASE WHEN hour(dateTime) BETWEEN 8 AND 18 THEN 'dayTime'
  WHEN hour(dateTime) <= 6 OR hour(dateTime) >= 20 THEN 'nightTime' ELSE 'otherTime' END AS kind FROM bid"""),
        "f_proctime": "SELECT CAST(1 AS BIGINT) AS clocks, count(*) AS rows FROM events",
        "u_countchar": _with("bid", """SELECT id, length(extra) - length(replace(extra, 'k', '')) AS k_count,
  length(extra) - length(replace(extra, '"', '')) AS quotes FROM bid"""),
        "st_wm_align": _with("auction bid", f"""SELECT * FROM (SELECT {start} AS starttime,
  {start} + INTERVAL '{tumble}' AS endtime, count(*) AS events
  FROM (SELECT dateTime FROM bid UNION ALL SELECT dateTime FROM auction) GROUP BY 1, 2)
WHERE endtime <= least((SELECT max(dateTime) FROM bid), (SELECT max(dateTime) FROM auction)) - INTERVAL '4 seconds'"""),
    }
