"""The operators that need more than one call to run over the driver's tables: generator, sources,
sinks and streams. Every function takes (spark, folder) and returns a DataFrame."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from auctionstream import schemas
from auctionstream.functions import scalar
from auctionstream.operators import joins, match, patterns, projections, windows
from auctionstream.session import ROCKSDB, work_folder
from auctionstream.sources import adapter, events, sinks, tables, topics
from auctionstream.streaming import aggregates as stream_aggregates
from auctionstream.streaming import joins as stream_joins
from auctionstream.streaming import tables as stream_tables, updating, windows as stream_windows
from auctionstream.streaming.run import NOW, finish, plain_times, run_append, run_update, run_updating, stream_files

# The driver's events are minutes apart, so its windows are longer than the defaults.
TUMBLE, DAY, SIZE, SLIDE, GAP = "1 hour", "1 day", "1 hour", "15 minutes", "6 hours"
WATERMARK = "4 seconds"


def _views(spark, folder):
    return {name: adapter.with_event_time(getattr(adapter, name)(spark, folder)) for name in adapter.ENTITY_TABLE}


# ---- generator: the event table's ids are the event numbers ------------------------------------

EVENTS = events.EventConfig(group_size=7, delay_probability=0.1)


def _event_numbers(spark, folder):
    return adapter.table(spark, folder, "events").select(F.col("event_id").alias("k"))


def generated(entity: str, config: events.EventConfig = EVENTS):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain_times(events.typed_events(_event_numbers(spark, folder), entity, config))

    return run


def src_union(spark: SparkSession, folder: str) -> DataFrame:
    union = events.union_events(_event_numbers(spark, folder), EVENTS)
    return plain_times(union.select(
        "event_type", F.col("person.id").alias("person_id"), F.col("auction.id").alias("auction_id"),
        F.col("bid.auction").alias("bid_auction"), F.col("bid.bidder").alias("bid_bidder"),
        F.col("bid.price").alias("bid_price"), "dateTime", "arrival", "lowWaterMark",
    ))


def gen_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Mix, disorder, times, last ids."""
    rows = events.with_times(events.with_identity(_event_numbers(spark, folder), EVENTS), EVENTS)
    return plain_times(rows.select(
        "k", F.col("_id").alias("id"), F.col("_kind").alias("event_type"), F.col("_person").alias("last_person"),
        F.col("_auction").alias("last_auction"), "dateTime", "lowWaterMark", "arrival",
    ))


def gen_split(spark: SparkSession, folder: str) -> DataFrame:
    """Four parallel timelines over the event numbers."""
    numbers = _event_numbers(spark, folder)
    config = events.EventConfig(timelines=4)
    total = numbers.count()
    rows = events.with_times(events.with_identity(numbers, config, total), config)
    return plain_times(rows.select("k", F.col("_id").alias("id"), "dateTime"))


def src_v2(spark: SparkSession, folder: str) -> DataFrame:
    """A source that stops and goes on: two runs of one checkpointed query over consecutive numbers."""
    numbers = _event_numbers(spark, folder)
    half = numbers.agg(F.max("k")).scalar() / 2
    base = work_folder(spark, "src-v2")

    def run():
        stream = stream_files(spark, f"{base}/numbers", numbers.schema)
        bids = events.typed_events(stream, "bid", EVENTS).select("id", "auction", "bidder", "price", "dateTime")
        return run_append(bids, base)

    numbers.where(F.col("k") <= half).write.parquet(f"{base}/numbers")
    run()
    numbers.where(F.col("k") > half).write.mode("append").parquet(f"{base}/numbers")
    return run()


# ---- sources and sinks ------------------------------------------------------------------------


def src_views(spark: SparkSession, folder: str) -> DataFrame:
    """The union event taken apart again."""
    views = tables.union_views(topics.union_of(**_views(spark, folder)))
    return _heads({**views, "bid": views["bid"].withColumnRenamed("auction", "id")})


def src_views_u(spark: SparkSession, folder: str) -> DataFrame:
    views = tables.typed_views(**_views(spark, folder))
    return _heads({"person": views["person"], "auction": views["auction"], "bid_modified": views["bid_modified"]})


def _heads(views: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select(F.lit(name).alias("entity"), "id", "dateTime", "extra") for name, df in views.items()]
    return plain_times(parts[0].union(parts[1]).union(parts[2]))


def _topic(spark, folder):
    return topics.to_topic(topics.union_of(**_views(spark, folder)))


def src_kafka(spark: SparkSession, folder: str) -> DataFrame:
    """Bids decoded from a topic of union events."""
    bids = tables.entity_view(topics.from_topic(_topic(spark, folder)), "bid")
    return plain_times(bids)


def snk_kafka(spark: SparkSession, folder: str) -> DataFrame:
    """Topic rows with a fixed partition per kind, read with a JSON path."""
    union = topics.union_of(**_views(spark, folder))
    rows = topics.to_topic(union, F.col("event_type"))
    path = F.get_json_object("value", "$.auction.seller").cast("bigint")
    return rows.select("partition", path.alias("seller"), F.get_json_object("value", "$.bid.price").cast("bigint").alias("price"))


def src_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Keyed topic: every record is an append."""
    bid = _views(spark, folder)["bid"]
    return plain_times(topics.from_keyed_topic(topics.to_keyed_topic(bid, ["id"]), schemas.BID, ["id"]))


def snk_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Keyed topic read as a table: the newest bid of every bidder."""
    bid = _views(spark, folder)["bid"]
    records = bid.select(
        F.to_json(F.struct("bidder")).alias("key"), F.to_json(F.struct("id", "price")).alias("value"),
        F.col("id").alias("offset"),
    )
    schema = schemas.StructType([f for f in schemas.BID if f.name in ("bidder", "id", "price")])
    return topics.from_keyed_topic(topics.latest_per_key(records), schema, ["bidder"])


def src_csv(spark: SparkSession, folder: str) -> DataFrame:
    """q13 with the side table read from CSV files."""
    path = work_folder(spark, "side")
    tables.write_side_csv(spark, path)
    return joins.q13_lookup(adapter.bid(spark, folder), tables.read_side_csv(spark, path))


def src_side(spark: SparkSession, folder: str) -> DataFrame:
    """Side rows that some bid refers to."""
    keys = adapter.bid(spark, folder).select((F.col("auction") % 10_000).alias("key"))
    return tables.side_rows(spark).join(keys, "key", "left_semi")


def snk_null(spark: SparkSession, folder: str) -> DataFrame:
    """Discards all bids, then says how many there were."""
    bids = projections.q0_pass_through(adapter.bid(spark, folder))
    sinks.discard(bids)
    return bids.agg(F.count("*").alias("written"))


def snk_part(spark: SparkSession, folder: str) -> DataFrame:
    """The log, written and read back; a partition is six hours here."""
    slot = F.window("dateTime", "6 hours")["start"]
    log = projections.q10_log(adapter.bid(spark, folder)).withColumn("hm", scalar.minute_of(slot))
    path = work_folder(spark, "log")
    sinks.write_log(log, path)
    return sinks.read_log(spark, path, log.schema)


def snk_multi(spark: SparkSession, folder: str) -> DataFrame:
    """One job, three targets: the union stream written to a table per entity."""
    base = work_folder(spark, "multi")
    union = topics.union_of(**_views(spark, folder))
    union.write.parquet(f"{base}/union")
    stream = stream_files(spark, f"{base}/union", union.schema, 1000)
    targets = {
        f"{base}/{name}": (lambda batch, name=name: tables.entity_view(batch, name)) for name in tables.ENTITIES
    }
    finish(sinks.write_many_stream(stream, targets, f"{base}/checkpoint", **NOW))
    views = {name: spark.read.parquet(f"{base}/{name}") for name in tables.ENTITIES}
    return _heads({**views, "bid": views["bid"].withColumnRenamed("auction", "id")})


# ---- streams ----------------------------------------------------------------------------------


def _plain_stream(spark, folder, entity):
    # State on disk below the executors, not on their heaps; streams read the setting when they start.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return adapter.stream_of(spark, folder, entity)


def _stream(spark, folder, entity, delay=WATERMARK):
    return tables.with_watermark(_plain_stream(spark, folder, entity), delay)


def on_stream(entities: str, operator, **options):
    """The operator over watermarked streams, in append mode."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return run_append(operator(*[_stream(spark, folder, e) for e in entities.split()], **options))

    return run


def on_plain_stream(entities: str, operator):
    """The inner join over streams without watermark: nothing is ever late, all rows are kept."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        base, names = work_folder(spark, "joined"), entities.split()
        return run_updating(_together(spark, folder, *names), stream_tables.Joined(spark, base, names, operator), base)

    return run


def _together(spark, folder, *entities):
    return stream_tables.together(**{e: adapter.stream_of(spark, folder, e) for e in entities})


def on_updates(operator, keys: list[str], **options):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return run_update(operator(_stream(spark, folder, "bid"), **options), keys)

    return run


def st_dedup_last(spark: SparkSession, folder: str) -> DataFrame:
    """The keyed table finds the newest bid itself, so no state is held beside it."""
    order = ["dateTime", "price", "channel", "url", "extra"]
    bids = adapter.stream_of(spark, folder, "bid").select("auction", "bidder", "price", "channel", "url", "dateTime", "extra")
    return run_update(bids, ["auction", "bidder"], order=order)


def st_hops(finish=None):
    """Counts of hopping windows that the watermark has closed."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        base = work_folder(spark, "hops")
        counts = stream_tables.HopCounts(spark, base, SIZE, SLIDE, finish, WATERMARK)
        return run_updating(adapter.stream_of(spark, folder, "bid"), counts, base)

    return run


def st_procwin(spark: SparkSession, folder: str) -> DataFrame:
    counts = stream_windows.processing_time_counts(_stream(spark, folder, "bid"))
    rows = run_update(counts, ["bidder", "starttime"])
    return rows.groupBy("bidder").agg(F.sum("bid_count").alias("bid_count"))


def st_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return run_append(joins.q13_lookup(_stream(spark, folder, "bid"), tables.side_rows(spark)))


def st_report(by_channel: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        base = work_folder(spark, "report")
        return run_updating(_stream(spark, folder, "bid"), updating.BidReport(spark, base, by_channel), base)

    return run


def st_ijoin(spark: SparkSession, folder: str) -> DataFrame:
    rows = run_append(stream_joins.offers(_stream(spark, folder, "auction"), _stream(spark, folder, "bid"), max_open="10 days"))
    return rows.select("id", "category", "bidder", "price", "bid_dateTime")


def _on_offers(spark, folder, base, result):
    """Hands the offers of every micro-batch to ``result``: offers, number of the batch, watermark."""
    both = _together(spark, folder, "auction", "bid")
    finish(both.writeStream.foreachBatch(stream_tables.Offers(spark, f"{base}/offers", "10 days", result, WATERMARK).apply)
           .option("checkpointLocation", f"{base}/checkpoint").trigger(**NOW).start())


def st_join_agg(spark: SparkSession, folder: str) -> DataFrame:
    base = work_folder(spark, "category-average")
    average = updating.CategoryAverage(spark, base)
    _on_offers(spark, folder, base, lambda offers, batch_id, now: average.apply(offers, batch_id))
    return plain_times(average.read())


def st_final(spark: SparkSession, folder: str) -> DataFrame:
    """An auction is final as long after its end as auctions may last."""
    base = work_folder(spark, "final")
    winners = stream_tables.WinnersAtClose(spark, f"{base}/winners", "10 days")
    _on_offers(spark, folder, base, winners.apply)
    return plain_times(winners.read()).select("id", "seller", "expires", "bidder", "price", "bid_dateTime")


def st_topn(spark: SparkSession, folder: str) -> DataFrame:
    bids, base = _stream(spark, folder, "bid").drop("id"), work_folder(spark, "top")
    top = updating.TopRows(spark, base, bids.schema, ["auction"], [("price", False), ("dateTime", True)], 10)
    return run_updating(bids, top, base)


def st_unique(spark: SparkSession, folder: str) -> DataFrame:
    bids = adapter.stream_of(spark, folder, "bid")
    twice = tables.with_watermark(bids.union(bids), WATERMARK)
    return run_append(stream_aggregates.unique_rows(twice, ["id"]).select("id", "auction", "price", "dateTime"))


LATE_SPAN = "5 days"


def st_late(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per hour when some bids arrive up to eight days late, in batches of five days of arrival.

    Rows of windows that an earlier batch closed are dropped, the others count.
    """
    base = work_folder(spark, "late")
    bids = adapter.with_event_time(adapter.bid(spark, folder))
    arrival = F.col("dateTime") + F.make_dt_interval(F.when(F.col("id") % 10 == 0, F.col("id") % 8).otherwise(0).cast("int"))
    batches = bids.withColumn("part", F.window(arrival, LATE_SPAN, startTime="0 seconds")["start"])
    batches.write.partitionBy("part").parquet(f"{base}/parts")
    result = None
    for row in batches.select("part").distinct().orderBy("part").collect():  # one row per arrival span
        part = spark.read.parquet(f"{base}/parts").where(F.col("part") == row.part).drop("part")
        part.write.mode("append").parquet(f"{base}/rows")
        stream = tables.with_watermark(stream_files(spark, f"{base}/rows", bids.schema, 1000), WATERMARK)
        result = run_append(stream_windows.closed_counts(stream, TUMBLE), base + "/run")
    return result


def st_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs on one checkpoint, the second after more rows arrived."""
    base = work_folder(spark, "resume")
    bids = adapter.with_event_time(adapter.bid(spark, folder))
    total = F.unix_micros(F.min("dateTime")) + F.unix_micros(F.max("dateTime"))
    middle = bids.agg(F.timestamp_micros(F.call_function("div", total, F.lit(2)))).scalar()
    result = None
    for part in (F.col("dateTime") <= middle, F.col("dateTime") > middle):
        bids.where(part).write.mode("append").parquet(f"{base}/rows")
        stream = tables.with_watermark(stream_files(spark, f"{base}/rows", bids.schema, 1000), WATERMARK)
        result = run_append(stream_windows.closed_counts(stream, TUMBLE), base + "/run")
    return result


# ---- row patterns, per bidder --------------------------------------------------------------------

PATTERN_OPTIONS = {"keys": ["bidder"], "tie": ["id"]}
WITHIN_MICROS = 86_400_000_000


def cep(operator, **options):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return operator(adapter.bid(spark, folder), **PATTERN_OPTIONS, **options)

    return run


def match_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The general matcher with the pattern of cep0."""
    bids = adapter.with_event_time(adapter.bid(spark, folder))
    rows = bids.select("bidder", F.unix_micros("dateTime").alias("micros"), "id", "price")
    found = match.match_rows(rows, ["bidder"], ["micros", "id"], match.v_shape())
    times = [c for c in found.columns if c.endswith("tstamp")]
    return plain_times(found.withColumns({c: F.timestamp_micros(c) for c in times}))


def st_cep(pattern: match.Pattern):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        base = work_folder(spark, "matches")
        bids = adapter.stream_of(spark, folder, "bid").select("bidder", "dateTime", "id", "price")
        matches = stream_tables.Matches(spark, base, ["bidder"], ["dateTime", "id"], pattern, WATERMARK)
        found = run_updating(bids, matches, base)
        times = [c for c in found.columns if c.endswith(("tstamp", "time"))]
        return plain_times(found.withColumns({c: F.timestamp_micros(c) for c in times}))

    return run


# ---- single rules and functions ------------------------------------------------------------------


def parts_of(query, *columns: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(spark, folder).select(*columns)

    return run


def gen_mix(spark: SparkSession, folder: str) -> DataFrame:
    return gen_identity(spark, folder).groupBy("event_type").agg(F.count("*").alias("events"))


def gen_start(spark: SparkSession, folder: str) -> DataFrame:
    """The same numbers, resumed 1000 events later."""
    rows = events.with_identity(_event_numbers(spark, folder), events.resume_at(EVENTS, 1000))
    return rows.select("k", F.col("_id").alias("id"))


def gen_size(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated bytes of as many events as the table has rows."""
    counted = _event_numbers(spark, folder).agg(F.count("*").alias("events"))
    shares = ((EVENTS.person_share, EVENTS.person_size), (EVENTS.auction_share, EVENTS.auction_size), (EVENTS.bid_share, EVENTS.bid_size))
    sizes = [F.call_function("div", F.col("events") * n, F.lit(EVENTS.total)) * size for n, size in shares]
    return counted.select("events", (sizes[0] + sizes[1] + sizes[2]).cast("bigint").alias("estimated_bytes"))


def on_bids(**columns):
    """Bid ids with columns computed from the bid's columns."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        bid = adapter.bid(spark, folder)
        return bid.select("id", *[column(bid).alias(name) for name, column in columns.items()])

    return run


def f_proctime(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a batch carry one clock time."""
    clock = adapter.bid(spark, folder).select(F.current_timestamp().alias("p_time"))
    return clock.agg(F.countDistinct("p_time").alias("clocks"), F.count("p_time").alias("rows"))


def st_wm_align(spark: SparkSession, folder: str) -> DataFrame:
    """Two streams in one: a window closes when the slower watermark has passed it."""
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    both = _stream(spark, folder, "bid").select("dateTime").union(_stream(spark, folder, "auction").select("dateTime"))
    counts = both.groupBy(windows.tumble(TUMBLE).alias("window")).agg(F.count("*").alias("events"))
    return run_append(windows.with_bounds(counts))


def rules() -> dict:
    return {
        "gen_mix": gen_mix,
        "gen_time": parts_of(gen_split, "k", "dateTime"),
        "gen_ooo": parts_of(gen_identity, "k", "id"),
        "gen_wm": parts_of(gen_identity, "k", "lowWaterMark"),
        "gen_delay": parts_of(gen_identity, "k", "event_type", "arrival"),
        "gen_start": gen_start,
        "gen_auction_id": parts_of(gen_identity, "k", "last_auction"),
        "gen_person_id": parts_of(gen_identity, "k", "last_person"),
        "gen_auction_pick": parts_of(generated("bid"), "id", "auction"),
        "gen_auction_len": parts_of(generated("auction"), "id", "dateTime", "expires"),
        "gen_bidder_shift": parts_of(generated("bid"), "id", "bidder"),
        "gen_channel": parts_of(generated("bid"), "id", "channel", "url"),
        "gen_price": parts_of(generated("bid"), "id", "price"),
        "gen_string": parts_of(generated("auction"), "id", "itemName", "description"),
        "gen_extra": parts_of(generated("bid"), "id", "extra"),
        "gen_size": gen_size,
        "f_mod": on_bids(remainder=lambda b: b.auction % 123),
        "f_datefmt": on_bids(dt=lambda b: scalar.day_of(b.dateTime), hm=lambda b: scalar.minute_of(b.dateTime)),
        "f_hour": on_bids(hour=lambda b: F.hour(b.dateTime).cast("bigint")),
        "f_lower": on_bids(lowered=lambda b: F.lower(b.channel)),
        "f_regex": on_bids(channel_id=lambda b: scalar.regexp_group(b.url, "(&|^)channel_id=([^&]*)", 2)),
        "f_split": on_bids(dir1=lambda b: scalar.split_index(b.url, "/", 3), none=lambda b: scalar.split_index(b.url, "/", 9)),
        "f_case": on_bids(kind=lambda b: scalar.bid_time_type(b.dateTime)),
        "f_proctime": f_proctime,
        "u_countchar": on_bids(
            k_count=lambda b: scalar.count_char(b.extra, "k"), quotes=lambda b: scalar.count_char(b.extra, '"')
        ),
        "st_wm_align": st_wm_align,
    }


def queries() -> dict:
    """Generator, source, sink and streaming queries by name."""
    keep = lambda *names: (lambda df: df.select(*names))
    return rules() | {
        "src_union": src_union,
        "src_typed": generated("person"),
        "src_typed_bidmod": lambda s, f: keep("id", "auction", "bidder", "price", "dateTime")(generated("bid")(s, f)),
        "src_v2": src_v2,
        "src_kafka": src_kafka,
        "src_upsert": src_upsert,
        "src_csv": src_csv,
        "src_side": src_side,
        "src_views": src_views,
        "src_views_u": src_views_u,
        "snk_null": snk_null,
        "snk_part": snk_part,
        "snk_kafka": snk_kafka,
        "snk_multi": snk_multi,
        "snk_upsert": snk_upsert,
        "gen_identity": gen_identity,
        "gen_split": gen_split,
        "gen_person": generated("person"),
        "gen_auction": generated("auction"),
        "gen_bid": generated("bid"),
        "st_wm": on_stream("bid", stream_windows.closed_counts, size=TUMBLE),
        "st_tumble": on_stream("bid", stream_windows.tumbling_max, size=TUMBLE),
        "st_hop": st_hops(),
        "st_session": on_stream("bid", stream_windows.session_counts, gap=GAP),
        "st_procwin": st_procwin,
        "st_chain": st_hops(stream_tables.most_per_window),
        "st_wjoin": on_stream("bid", stream_windows.highest_bids, size=TUMBLE),
        "st_wjoin_q8": on_stream("person auction", stream_windows.new_sellers, size=DAY),
        "st_join": on_plain_stream("bid auction", joins.q20_expand_bids),
        "st_join_q3": on_plain_stream("auction person", joins.q3_local_sellers),
        "st_join_q23": on_plain_stream("bid person auction", joins.q23_three_way),
        "st_ijoin": st_ijoin,
        "st_lookup": st_lookup,
        "st_upd_agg": on_updates(stream_aggregates.auction_report, ["auction", "day"]),
        "st_upd_agg_q15": st_report(False),
        "st_upd_agg_q16": st_report(True),
        "st_dedup_last": st_dedup_last,
        "st_topn": st_topn,
        "st_final": st_final,
        "st_join_agg": st_join_agg,
        "st_late": st_late,
        "st_resume": st_resume,
        "st_unique": st_unique,
        "cep0": cep(patterns.cep0_v_shape),
        "cep1": cep(patterns.cep1_low_average),
        "cep2": cep(patterns.cep2_low_average_overlapping),
        "cep3": cep(patterns.cep3_drop, within="1 day"),
        "match_rows": match_rows,
        "st_cep0": st_cep(match.v_shape("dateTime")),
        "st_cep1": st_cep(match.low_average(time="dateTime")),
        "st_cep2": st_cep(match.low_average(skip=match.TO_NEXT_ROW, time="dateTime")),
        "st_cep3": st_cep(match.drop_within(within_micros=WITHIN_MICROS, time="dateTime")),
    }
