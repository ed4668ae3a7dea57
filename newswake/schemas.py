"""Table shapes at rest. Values are computed in double and rounded to these scales on write."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

RETURN = T.DecimalType(10, 6)
PRICE = T.DecimalType(15, 2)
ZSCORE = T.DecimalType(10, 4)


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


DAILY_PRICE = _struct(
    stock_code=T.StringType(), trade_date=T.DateType(), stock_name=T.StringType(),
    close_price=PRICE,
)

ANALYZED_NEWS = _struct(
    url=T.StringType(), title=T.StringType(), stock_name=T.StringType(),
    event_code=T.StringType(), date=T.DateType(),
)

EVENT_RETURNS_HISTORY = _struct(
    stock_code=T.StringType(), event_date=T.DateType(), event_code=T.StringType(),
    anchor_date=T.DateType(), anchor_price=PRICE,
    return_1d=RETURN, return_3d=RETURN, return_5d=RETURN,
    volume=T.LongType(), market_cap=T.DecimalType(20, 2),
    created_at=T.TimestampType(), updated_at=T.TimestampType(),
)

NEWS_RETURNS = _struct(
    news_id=T.StringType(), stock_code=T.StringType(), stock_name=T.StringType(),
    event_code=T.StringType(), news_date=T.DateType(), anchor_price=PRICE,
    return_1d=RETURN, return_3d=RETURN, return_5d=RETURN,
)

NEWS_GAPS = _struct(
    news_id=T.StringType(), news_title=T.StringType(), stock_code=T.StringType(),
    stock_name=T.StringType(), event_code=T.StringType(), news_date=T.DateType(),
    horizon=T.IntegerType(), actual_return=RETURN, expected_return=RETURN, expected_std=RETURN,
    z_score=ZSCORE, direction=T.StringType(), magnitude=T.StringType(),
    sample_count=T.LongType(), calc_mode=T.StringType(), detected_at=T.TimestampType(),
)

STOCK_LIST = _struct(
    stock_code=T.StringType(), corp_code=T.StringType(), corp_name=T.StringType(),
    market=T.StringType(),
)

DISCLOSURE = _struct(
    rcept_no=T.StringType(), rcept_dt=T.StringType(), corp_code=T.StringType(),
    corp_name=T.StringType(), report_nm=T.StringType(), flr_nm=T.StringType(),
    rm=T.StringType(), pblntf_ty=T.StringType(), counterparty=T.StringType(),
)

NEWS_ARTICLE = _struct(
    id=T.StringType(), title=T.StringType(), published_at=T.StringType(),
    publisher=T.StringType(), category=T.StringType(), url=T.StringType(),
    stock_name=T.StringType(), body=T.StringType(),
    created_at=T.TimestampType(), updated_at=T.TimestampType(),
)

NEWS_DOCUMENT = _struct(
    id=T.StringType(), oid=T.StringType(), aid=T.StringType(), title=T.StringType(),
    keyphrases=T.ArrayType(T.StringType()), title_simhash=T.StringType(),
    published_at=T.TimestampType(), publisher=T.StringType(), publisher_tier=T.DoubleType(),
    category=T.StringType(), url=T.StringType(), canonical_url=T.StringType(),
    companies=T.ArrayType(T.StringType()), companies_kw=T.ArrayType(T.StringType()),
    companies_raw=T.ArrayType(T.StringType()), tickers=T.ArrayType(T.StringType()),
    events=T.ArrayType(T.StringType()), event_codes=T.ArrayType(T.StringType()),
    event_conf=T.DoubleType(), embedding=T.ArrayType(T.FloatType()), body=T.StringType(),
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project `df` onto a table shape: cast what is there, null for what is not."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
