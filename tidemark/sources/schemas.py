"""Schemas of the tables."""

from pyspark.sql import types as T

# Names and kinds of the columns of the data model.
SYMBOLS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("meaning", T.StringType())]))
FORTUNE = T.StructType([T.StructField(n, T.StringType()) for n in ("wealth", "relationship", "love", "health", "omen")])

#: Kinds of an entry.
DREAM, TAROT = "DREAM", "TAROT"
KINDS = (DREAM, TAROT)

ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("userId", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        *(T.StructField(n, T.StringType()) for n in ("dreamText", "mood", "advice", "title", "traditional", "psychological")),
        T.StructField("symbols", SYMBOLS),
        T.StructField("fortune", FORTUNE),
        *(T.StructField(n, T.StringType()) for n in ("cardName", "cardKeyword", "tarotAdvice")),
        T.StructField("reversed", T.BooleanType()),
        T.StructField("createdAt", T.TimestampNTZType(), False),
        # nested members as they came, with what the columns above don't hold
        *(T.StructField(n, T.StringType()) for n in ("symbolsJson", "fortuneJson")),
    ]
)

CARD = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "keyword", "uprightMeaning", "reversedMeaning", "arcana", "suit", "image")])

REQUEST = T.StructType([T.StructField("id", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("request_ts", T.TimestampNTZType()), T.StructField("raw_body", T.StringType())])
