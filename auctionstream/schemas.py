"""Fixed schemas of the three entities, the union event and the side table."""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _schema(**fields):
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


PERSON = _schema(
    id=LongType(), name=StringType(), emailAddress=StringType(), creditCard=StringType(),
    city=StringType(), state=StringType(), dateTime=TimestampType(), extra=StringType(),
)
AUCTION = _schema(
    id=LongType(), itemName=StringType(), description=StringType(), initialBid=LongType(),
    reserve=LongType(), dateTime=TimestampType(), expires=TimestampType(), seller=LongType(),
    category=LongType(), extra=StringType(),
)
# Only the flat bid table carries the event id.
UNION_BID = _schema(
    auction=LongType(), bidder=LongType(), price=LongType(), channel=StringType(),
    url=StringType(), dateTime=TimestampType(), extra=StringType(),
)
BID = StructType([StructField("id", LongType(), True), *UNION_BID.fields])

PERSON_EVENT, AUCTION_EVENT, BID_EVENT = 0, 1, 2
UNION = StructType([
    StructField("event_type", IntegerType(), False),
    StructField("person", PERSON, True),
    StructField("auction", AUCTION, True),
    StructField("bid", UNION_BID, True),
])
SIDE = _schema(key=LongType(), value=StringType())
