"""Synthetic auction events as Catalyst columns over event numbers.

Every column is an integer or string expression of the event number, so rows are generated where
they are needed, in whole-stage codegen, and do not depend on how the numbers are partitioned. The
same builder serves a range of numbers, any table with a number column and the micro-batch source.

Random choices come from ``mixed`` and ``draw``: integer arithmetic modulo a prime, which other SQL
engines can repeat.
"""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from auctionstream import schemas

# First ids, spans of hot keys, lead of ids that do not exist yet, and the word lists.
FIRST_PERSON_ID = FIRST_AUCTION_ID = 1000
FIRST_CATEGORY, CATEGORIES = 10, 5
HOT_SPAN = 100
ID_LEAD = 10
CHANNELS = 10_000
OUT_OF_ORDER_STEP = 953
STATES = ["AZ", "CA", "ID", "OR", "WA", "WY"]
CITIES = [
    "Phoenix", "Los Angeles", "San Francisco", "Boise", "Portland", "Bend", "Redmond", "Seattle", "Kent", "Cheyenne",
]
FIRST_NAMES = ["Peter", "Paul", "Luke", "John", "Saul", "Vicky", "Kate", "Julie", "Sarah", "Deiter", "Walter"]
LAST_NAMES = ["Shultz", "Abrams", "Spencer", "White", "Bartels", "Walton", "Smith", "Jones", "Noris"]
HOT_CHANNELS = ["Google", "Facebook", "Baidu", "Apple"]

# Constants of the draw. PRIME keeps every product below 2**63.
PRIME = 2_147_483_647
ID_FACTOR, ROUND_FACTOR, MIX_FACTOR, STEP_FACTOR = 48_271, 69_621, 1_583_458_089, 16_807


@dataclass(frozen=True)
class EventConfig:
    """Options of the event source. Sizes in bytes, rate in events per second, delays in seconds."""

    rate: int = 10_000
    person_share: int = 1
    auction_share: int = 3
    bid_share: int = 46
    person_size: int = 200
    auction_size: int = 500
    bid_size: int = 100
    hot_auctions: int = 2
    hot_bidders: int = 4
    hot_sellers: int = 4
    in_flight_auctions: int = 100
    active_people: int = 1000
    group_size: int = 1
    delay_probability: float = 0.0
    delay_min: int = 60
    delay_max: int = 240
    base_time: int = 1_700_000_000_000
    first_event_id: int = 1
    first_event_number: int = 1
    timelines: int = 1
    # The published rule adds the first person id twice, so bidders are 1000 above persons; with
    # FIRST_PERSON_ID instead a bidder is a person.
    bidder_offset: int = 2 * FIRST_PERSON_ID
    seed: int = 0

    @property
    def total(self) -> int:
        return self.person_share + self.auction_share + self.bid_share

    def estimated_bytes(self, events: int) -> int:
        """Size of that many events by share and average size."""
        shares = (
            (self.person_share, self.person_size), (self.auction_share, self.auction_size), (self.bid_share, self.bid_size),
        )
        return sum(events * share // self.total * size for share, size in shares)


DEFAULT = EventConfig()


# ---- draws ------------------------------------------------------------------------------------


def mixed(number: Column, seed: int = 0) -> Column:
    """Pseudo-random integer in [0, PRIME), fixed by the number and the seed."""
    linear = (number % PRIME * ID_FACTOR + _div(number, PRIME) * ROUND_FACTOR + seed * 7919 + 1) % PRIME
    return linear.bitwiseXOR(F.shiftright(linear, 15)) * MIX_FACTOR % PRIME


def draw(mix: Column, slot: int) -> Column:
    """The slot-th step of a multiplicative generator that starts from the mixed number."""
    return mix * pow(STEP_FACTOR, slot, PRIME) % PRIME


def _div(value: Column, by: int | Column) -> Column:
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def filler(length: int, separator: str = "") -> str:
    """Lowercase text made by a linear rule; every 13th letter on average is the separator."""
    state, letters = 12_345, []
    for _ in range(length):
        state = (state * 1_103_515_245 + 12_345) % 2**31
        value = state >> 8
        letters.append(separator if separator and value % 13 == 0 else chr(97 + value // 13 % 26))
    return "".join(letters)


TEXT_LENGTH, PIECE = 2048, 16
WORDS, PATHS = filler(TEXT_LENGTH, " "), filler(TEXT_LENGTH, "_")


# ---- event columns ----------------------------------------------------------------------------
#
# Columns are built in stages of withColumns. A value that several later columns use is a column of
# an earlier stage, so it is computed once per row; columns that start with '_' are dropped at the end.

PERSON_SLOTS, AUCTION_SLOTS, BID_SLOTS = range(1, 15), range(1, 24), range(1, 11)
DELAY_SLOTS, CHANNEL_SLOTS = range(30, 32), range(50, 58)
KINDS = {"person": schemas.PERSON_EVENT, "auction": schemas.AUCTION_EVENT, "bid": schemas.BID_EVENT}
FIELDS = {"person": schemas.PERSON, "auction": schemas.AUCTION, "bid": schemas.BID}
SLOTS = {"person": PERSON_SLOTS, "auction": AUCTION_SLOTS, "bid": BID_SLOTS}


def _d(slot: int) -> Column:
    return F.col(f"_d{slot}")


def adjusted_number(number: Column, group_size: int) -> Column:
    """Bounded disorder: the numbers of every group of that size are permuted."""
    if group_size == 1:
        return number
    return number - number % group_size + number * OUT_OF_ORDER_STEP % group_size


def event_millis(number: Column, config: EventConfig) -> Column:
    micros = 1e6 / config.rate * config.timelines
    return config.base_time + _div((number * F.lit(micros)).cast("bigint"), 1000)


def with_identity(df: DataFrame, config: EventConfig, events: int | None = None) -> DataFrame:
    """From ``k``: event number, event id, kind, times and the last person and auction so far.

    Several timelines cut the numbers into that many ranges, which all start at the same time; that
    takes the total number of events.
    """
    c, k, first = config, F.col("k").cast("bigint"), F.lit(config.first_event_id)
    number = k + c.first_event_number
    if c.timelines > 1:
        if not events:
            raise ValueError("several timelines need the number of events")
        per_line = max(events // c.timelines, 1)
        skipped = F.least(_div(k, per_line), F.lit(c.timelines - 1)) * per_line
        number, first = number - skipped, first + skipped
    out = df.withColumns({"_number": number, "_adjusted": adjusted_number(number, c.group_size), "_first": first})
    out = out.withColumn("_id", (F.col("_first") + F.col("_adjusted")).cast("bigint"))
    out = out.withColumns({
        "_epoch": _div(F.col("_id"), c.total),
        "_offset": F.col("_id") % c.total,
        "_millis": event_millis(F.col("_adjusted"), c),
        "_mix": mixed(F.col("_id"), c.seed),
    })
    epoch, offset = F.col("_epoch"), F.col("_offset")
    behind = offset - c.person_share
    kind = (
        F.when(offset < c.person_share, schemas.PERSON_EVENT)
        .when(behind < c.auction_share, schemas.AUCTION_EVENT)
        .otherwise(schemas.BID_EVENT)
    )
    last_auction = F.when(behind < 0, epoch * c.auction_share - 1).otherwise(
        epoch * c.auction_share + F.least(behind, F.lit(c.auction_share - 1))
    )
    return out.withColumns({
        "_kind": kind,
        "_person": epoch * c.person_share + F.least(offset, F.lit(c.person_share - 1)),
        "_auction": last_auction,
    })


def with_times(df: DataFrame, config: EventConfig) -> DataFrame:
    """Event time, low-water mark (no event of this group or a later one undercuts it) and arrival.

    Events arrive in the order of their numbers, but some auctions and bids are delayed.
    """
    c, number = config, F.col("_number")
    spread = max((c.delay_max - c.delay_min) * 1000 + 1, 1)
    drawn = df.withColumns({f"_d{s}": draw(F.col("_mix"), s) for s in DELAY_SLOTS})
    late = (F.col("_kind") != schemas.PERSON_EVENT) & (_d(30) / PRIME < c.delay_probability)
    delay = F.when(late, c.delay_min * 1000 + _d(31) % spread).otherwise(0)
    return drawn.withColumns({
        "dateTime": F.timestamp_millis(F.col("_millis")),
        "arrival": F.timestamp_millis(event_millis(number, c) + delay),
        "lowWaterMark": F.timestamp_millis(event_millis(number - number % c.group_size, c)),
    })


def any_person(slot: int, config: EventConfig) -> Column:
    """One of the active persons or of the few that follow."""
    people = F.col("_person") + 1
    active = F.least(people, F.lit(config.active_people))
    return people - active + _d(slot) % (active + ID_LEAD)


def any_auction(slot: int, config: EventConfig) -> Column:
    """One of the auctions in flight or of the few that follow."""
    oldest = F.greatest(F.col("_auction") - config.in_flight_auctions, F.lit(0))
    return oldest + _d(slot) % (F.col("_auction") - oldest + 1 + ID_LEAD)


def price(slot: int) -> Column:
    """Log-uniform from 100 to 10**8."""
    return F.round(F.pow(F.lit(10.0), _d(slot) / F.lit(float(PRIME)) * 6.0) * 100.0).cast("bigint")


def cut(pool: str, start: Column, length: Column) -> Column:
    """Part of the pool as bytes: a binary substring jumps to its start, one of text walks there."""
    return F.substring(F.lit(bytearray(pool.encode())), start.cast("int"), length.cast("int"))


def text(drawn: list[Column], limit: int, pool: str = WORDS) -> Column:
    """3 to limit-1 characters cut from the pool in pieces, without outer blanks. The first draw is
    for the length, the others for the pieces."""
    pieces = [cut(pool, 1 + d % (TEXT_LENGTH - PIECE), F.lit(PIECE)) for d in drawn[1:]]
    joined = pieces[0] if len(pieces) == 1 else F.concat(*pieces)
    length = (3 + drawn[0] % (limit - 3)).cast("int")
    return F.trim(F.substring(joined, F.lit(1), length).cast("string"))


def _extra(rest: Column, average: int, slot: int) -> Column:
    """Filler that brings the row to its average size, give or take a fifth."""
    delta = F.round(rest * 0.2).cast("bigint")
    size = rest - delta + F.when(delta == 0, 0).otherwise(_d(slot) % F.greatest(delta * 2, F.lit(1)))
    pool = filler(max(TEXT_LENGTH, 4 * average))
    start = 1 + _d(slot + 1) % (len(pool) - 2 * average)
    return F.when(rest < 0, "").otherwise(cut(pool, start, size).cast("string"))


def _person(df: DataFrame, c: EventConfig) -> DataFrame:
    mail = F.concat(text([_d(3), _d(4)], 7), F.lit("@"), text([_d(5), _d(6)], 5), F.lit(".com"))
    card = F.concat_ws(" ", *[F.lpad((_d(s) % 10_000).cast("string"), 4, "0") for s in range(7, 11)])
    out = df.withColumns({
        "person_id": F.col("_person") + FIRST_PERSON_ID,
        "person_name": F.concat(pick(FIRST_NAMES, _d(1)), F.lit(" "), pick(LAST_NAMES, _d(2))),
        "person_emailAddress": mail,
        "person_creditCard": card,
        "person_city": pick(CITIES, _d(11)),
        "person_state": pick(STATES, _d(12)),
        "person_dateTime": F.timestamp_millis(F.col("_millis")),
    })
    parts = [F.length(f"person_{n}") for n in ("name", "emailAddress", "creditCard", "city", "state")]
    out = out.withColumn("_person_rest", c.person_size - 8 - sum(parts[1:], parts[0]))
    return out.withColumn("person_extra", _extra(F.col("_person_rest"), c.person_size, 13))


def _auction(df: DataFrame, c: EventConfig) -> DataFrame:
    """An auction lasts 1 ms to twice the time in which as many auctions start as are in flight."""
    ahead = c.in_flight_auctions * c.total // max(c.auction_share, 1)
    horizon = event_millis(F.col("_adjusted") + ahead, c) - F.col("_millis")
    hot_seller = F.col("_person") - F.col("_person") % HOT_SPAN
    seller = F.when(_d(19) % c.hot_sellers > 0, hot_seller).otherwise(any_person(20, c))
    out = df.withColumns({
        "auction_id": F.col("_auction") + FIRST_AUCTION_ID,
        "auction_itemName": text([_d(s) for s in range(1, 4)], 20),
        "auction_description": text([_d(s) for s in range(5, 13)], 100),
        "auction_initialBid": price(16),
        "auction_dateTime": F.timestamp_millis(F.col("_millis")),
        "auction_expires": F.timestamp_millis(
            F.col("_millis") + 1 + _d(18) % F.greatest(horizon * 2, F.lit(1))
        ),
        "auction_seller": FIRST_PERSON_ID + seller,
        "auction_category": FIRST_CATEGORY + _d(21) % CATEGORIES,
    })
    used = 48 + F.length("auction_itemName") + F.length("auction_description")
    out = out.withColumns({
        "auction_reserve": F.col("auction_initialBid") + price(17),
        "_auction_rest": c.auction_size - used,
    })
    return out.withColumn("auction_extra", _extra(F.col("_auction_rest"), c.auction_size, 22))


def _bid(df: DataFrame, c: EventConfig) -> DataFrame:
    """Half of the bids come through a well-known channel; the url depends on the channel alone."""
    hot_auction = F.col("_auction") - F.col("_auction") % HOT_SPAN
    hot_bidder = F.col("_person") - F.col("_person") % HOT_SPAN + 1
    channel = F.when(_d(6) % 2 > 0, CHANNELS + _d(7) % len(HOT_CHANNELS)).otherwise(_d(8) % CHANNELS)
    out = df.withColumn("_channel", channel)
    out = out.withColumn("_channel_mix", mixed(F.col("_channel")))
    out = out.withColumns({f"_d{s}": draw(F.col("_channel_mix"), s) for s in CHANNEL_SLOTS})
    dirs = [text([_d(s), _d(s + 1)], 5, PATHS) for s in (50, 52, 54)]
    is_cold = F.col("_channel") < CHANNELS
    suffix = F.when(is_cold & (_d(56) % 10 > 0), F.concat(F.lit("&channel_id="), _d(57).cast("string"))).otherwise("")
    url = F.concat(F.lit("https://www.example.com/"), F.concat_ws("/", *dirs), F.lit("/item.htm?query=1"), suffix)
    cold_name = F.concat(F.lit("channel-"), F.col("_channel").cast("string"))
    return out.withColumns({
        "bid_id": F.col("_id"),
        "bid_auction": FIRST_AUCTION_ID + F.when(_d(1) % c.hot_auctions > 0, hot_auction).otherwise(any_auction(2, c)),
        "bid_bidder": c.bidder_offset + F.when(_d(3) % c.hot_bidders > 0, hot_bidder).otherwise(any_person(4, c)),
        "bid_price": price(5),
        "bid_channel": F.when(is_cold, cold_name).otherwise(pick(HOT_CHANNELS, F.col("_channel"))),
        "bid_url": url,
        "bid_dateTime": F.timestamp_millis(F.col("_millis")),
        "bid_extra": _extra(F.lit(c.bid_size - 32), c.bid_size, 9),
    })


BUILDERS = {"person": _person, "auction": _auction, "bid": _bid}


def _with_draws(df: DataFrame, slots) -> DataFrame:
    return df.withColumns({f"_d{s}": draw(F.col("_mix"), s) for s in slots})


def _fields(entity: str) -> list[Column]:
    return [F.col(f"{entity}_{f.name}").cast(f.dataType).alias(f.name) for f in FIELDS[entity]]


# ---- sources ----------------------------------------------------------------------------------


def numbers(spark: SparkSession, events: int, config: EventConfig = DEFAULT, partitions: int | None = None) -> DataFrame:
    """Event numbers 0 .. events-1; the partition count follows the estimated size by default."""
    partitions = partitions or max(spark.sparkContext.defaultParallelism, config.estimated_bytes(events) // (128 << 20))
    return spark.range(0, events, 1, partitions).withColumnRenamed("id", "k")


def stream_numbers(spark: SparkSession, per_batch: int, advance_millis: int = 1000) -> DataFrame:
    """Event numbers as an unbounded stream of micro-batches."""
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch)
    return source.option("advanceMillisPerBatch", advance_millis).load().select(F.col("value").alias("k"))


def union_events(numbers_df: DataFrame, config: EventConfig = DEFAULT, events: int | None = None) -> DataFrame:
    """One row per number: event_type, the struct of that type, event time, arrival and low-water mark.

    A branch per entity generates only what it needs, and a filter on event_type removes the others.
    """
    union = None
    for entity, kind in KINDS.items():
        flat = typed_events(numbers_df, entity, config, events, with_arrival=True)
        structs = {
            name: StructType([f for f in schema if (name, f.name) != ("bid", "id")]) for name, schema in FIELDS.items()
        }
        columns = [
            F.struct(*structs[name].fieldNames()).alias(name) if name == entity else F.lit(None).cast(schema).alias(name)
            for name, schema in structs.items()
        ]
        rows = flat.select(F.lit(kind).alias("event_type"), *columns, "dateTime", "arrival", "lowWaterMark")
        union = rows if union is None else union.union(rows)
    return union


def typed_events(
    numbers_df: DataFrame, entity: str, config: EventConfig = DEFAULT, events: int | None = None,
    with_arrival: bool = False,
) -> DataFrame:
    """The rows of one entity as a flat table. Only its own columns are generated."""
    rows = with_identity(numbers_df, config, events).where(F.col("_kind") == KINDS[entity])
    late = ["arrival", "lowWaterMark"] if with_arrival else []
    if with_arrival:
        rows = with_times(rows, config)
    rows = BUILDERS[entity](_with_draws(rows, SLOTS[entity]), config)
    return rows.select(*_fields(entity), *late)


def resume_at(config: EventConfig, done: int) -> EventConfig:
    """The configuration that continues after ``done`` events of a single timeline."""
    return replace(config, first_event_number=config.first_event_number + done)
