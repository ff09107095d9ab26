"""Views of the test tables in the shapes the operators read.

Each view derives every row from a row of the given tables, so work grows with them. Part and customer
grow with the data and are joined without hints; Spark picks the join from their size. So does supplier,
whose size after its own joins Spark overestimates: counted to be short, it is broadcast.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricelens.functions.json_values import bind
from pricelens.schemas import RETAILER_TEMPLATES
from pricelens.session import shared_dir
from pricelens.sources import tables

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
OWN_BRAND, SUB_BRAND, WATCHED = "Brand#1", "Brand#2", "widget"
BRANDS = [f"Brand#{n}" for n in range(1, 10)]
RETAILERS = [name for name, _, _ in RETAILER_TEMPLATES]
AS_OF = datetime.datetime(2002, 1, 1)
AUDIT_DAY, AUDIT_DAYS = datetime.date(2024, 1, 31), 7
AUDIT_SCOPE = "scope_1"
AUDIT_ACTIONS = ["click", "purchase"]


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is looked up once; with a schema no file is opened to plan a read."""
    path = f"{sf_dir}/{name}.parquet"
    if (sf_dir, name) not in _SCHEMAS:
        _SCHEMAS[sf_dir, name] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[sf_dir, name]).parquet(path)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same file as a stream source."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, view: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A view written once per session, in the cluster's shared folder: fetched payloads are a table
    in a real feed too, and writing their JSON would cost more than reading it."""
    key = (spark.sparkContext.applicationId, sf_dir, view.__name__)
    if key in _STORED:
        try:
            return spark.read.parquet(_STORED[key])
        except AnalysisException:
            pass  # the folder was cleared, so it is written again
    path = shared_dir(spark, view.__name__)
    # Files of bounded length, so that a later read has something to deal to the cores.
    view(spark, sf_dir).write.option("maxRecordsPerFile", 20_000).parquet(path)
    _STORED[key] = path
    return spark.read.parquet(path)


#: Suppliers that are sent to all tasks; beyond it Spark chooses the join.
SHOPS = 1_000_000


def _shop_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to region, and to the retailer that the region stands for. Line items then stay where they are."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    shops = (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "s_suppkey",
            F.lower("r_name").alias("region"),
            F.get(F.array(*[F.lit(name) for name in RETAILERS]), F.col("r_regionkey")).alias("shop"),
        )
    )
    return F.broadcast(shops) if table(spark, sf_dir, "supplier").limit(SHOPS + 1).count() <= SHOPS else shops


def shelf(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None, by_day: bool = False) -> DataFrame:
    """The shelf feed: a line item is a product on a page, its quarter the snapshot. With ``by_day`` the rows of
    a snapshot are put together while they are narrow, before the columns that follow from others are added."""
    lines = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    on_sale = F.col("l_discount") > 0
    joined = (
        lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(_shop_regions(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("captured_on", F.date_trunc("quarter", "l_shipdate").cast("date"))
    )
    if by_day:
        of_part = ["p_partkey", "p_type", "p_name", "p_brand", "p_size"]
        of_line = [*ROW_KEY, "l_extendedprice", "l_discount", "l_returnflag"]
        joined = joined.select("region", *of_part, *of_line, "captured_on").hint("rebalance", F.col("captured_on"))
    return (
        joined.select(
            F.col("region").alias("retailer"),
            F.lower("p_type").alias("search_keyword"),
            F.col("l_linenumber").alias("position"),
            F.col("p_name").alias("product_name"),
            F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("brand"),
            price.alias("price"),
            F.when(on_sale, F.col("l_extendedprice")).alias("list_price"),
            F.when(
                on_sale,
                F.round(100 * (F.col("l_extendedprice") - price) / F.col("l_extendedprice"), 1),
            ).alias("discount_pct"),
            F.when(F.col("p_partkey") % 13 != 0, 1 + F.col("p_partkey") % 9 / 2).alias("rating"),
            (F.col("p_size") * 37).alias("review_count"),
            F.when(F.col("l_returnflag") == "R", True)
            .when(F.col("l_returnflag") == "A", False)
            .alias("sponsored"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.concat(
                F.lit("https://shop.example.com/"), "region", F.lit("/"), F.col("l_partkey").cast("string")
            ).alias("product_url"),
            "captured_on",
            F.col("l_shipdate").cast("timestamp").alias("captured_at"),
            *ROW_KEY,
        )
    )


def shelf_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shelf feed as the dated history the reports read: a folder per snapshot, written once per session."""
    key, feed = (spark.sparkContext.applicationId, sf_dir, "shelf_history"), shelf(spark, sf_dir, by_day=True)
    if key in _STORED:
        try:
            return tables.read_history(spark, _STORED[key], feed.schema).select(feed.columns)
        except AnalysisException:
            pass  # the folder was cleared, so it is written again
    path = shared_dir(spark, "shelf_history")
    tables.append_snapshot(feed, path, dealt=True)
    _STORED[key] = path
    return tables.read_history(spark, path, feed.schema).select(feed.columns)


def tie_break() -> list[Column]:
    return [F.col(name) for name in ROW_KEY]


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control table: each retailer and keyword with some product. Products without a brand are
    looked for at a shop that no template knows."""
    known = F.col("p_partkey") % 11 != 0
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(_shop_regions(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.when(known, F.col("shop")).otherwise("corner shop").alias("retailer"),
            F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("keyword"),
        )
        .groupBy("retailer", "keyword")
        .agg((F.count(F.lit(1)) % 3 != 0).alias("enabled"))
    )


def _item_of_shop(fields: dict[str, dict[str, Column]]) -> Column:
    """JSON of the fields that each shop sends. A shop's object holds its own fields alone, instead of all fields with
    a case for each shop."""
    chain = None
    for shop in RETAILERS:
        own = F.to_json(F.struct(*[by_shop[shop].alias(name) for name, by_shop in fields.items() if shop in by_shop]))
        same = F.col("shop") == shop
        chain = F.when(same, own) if chain is None else chain.when(same, own)
    return chain.otherwise("{}")


def product_words() -> tuple[Column, Column, Column]:
    """Name, given brand and URL slug of a part, such that every brand rule has its parts."""
    part = F.col("p_partkey")
    sort = part % 10
    name = (
        F.when(sort == 0, "Nike Air Jordan 1")
        .when(sort == 1, "Air Zoom Pegasus")
        .when(sort == 3, "On Cloudmonster 2")
        .when(sort == 4, "Shoe on sale")
        .when(sort == 5, "Trail shoe")
        .when(sort == 6, "Come on Running")
        .when(sort == 7, F.concat(F.lit("ASICS "), "p_name"))
        .when(sort == 8, "Plain shoe")
        .otherwise(F.col("p_name"))
    )
    given = (
        F.when(sort == 1, "nike")
        .when(sort == 4, "Men's")
        .when(sort == 5, " Altra ")
        .when(sort == 8, "   ")
        .when(sort != 9, F.col("p_brand"))
    )
    slug = F.when(sort == 2, "Under-Armour-Charged").otherwise(
        F.concat(F.lit("item-"), part.cast("string"))
    )
    return name, given, slug


def items(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Search-result items as JSON, each retailer with its own field names and value types."""
    lines = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    joined = lines.join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).join(_shop_regions(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))

    part, line = F.col("p_partkey"), F.col("l_linenumber")
    name, given, slug = product_words()
    cents = F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0")
    amount = F.concat((part % 200 + 20).cast("string"), F.lit("."), cents)
    list_amount = F.concat((part % 200 + 10 + 5 * line).cast("string"), F.lit("."), cents)
    money = F.concat(F.lit("$"), amount)
    reviews = F.concat(
        line.cast("string"), F.lit(","), F.lpad((part % 1000).cast("string"), 3, "0"), F.lit(" reviews")
    )
    identity = F.concat(F.lit("P"), part.cast("string"))
    flag = F.col("l_returnflag")
    stock = F.col("l_orderkey") % 4

    item = _item_of_shop(
        {
            "position": dict(amazon=line, walmart=line),
            "item_stack_position": dict(target=F.concat(line.cast("string"), F.lit(".0")), footlocker=F.concat(line.cast("string"), F.lit(".6")), asos=line.cast("string")),
            "product_name": dict(amazon=name, walmart=name, footlocker=name, asos=F.lit("")),
            "title": dict(target=name, asos=name),
            "product_brand": dict(amazon=given, target=given, asos=given),
            "brand": dict(walmart=given, footlocker=given),
            "price": dict(amazon=money, asos=F.lit("")),
            "product_price": dict(walmart=money, asos=F.concat(F.lit("USD "), amount)),
            "price_current": dict(target=amount.cast("double"), footlocker=amount.cast("double")),
            "original_price": dict(amazon=F.when(stock != 0, F.concat(F.lit("List: $"), list_amount)), asos=list_amount),
            "product_price_original": dict(walmart=F.when(stock != 0, list_amount.cast("double"))),
            "list_price": dict(target=F.when(stock != 0, list_amount)),
            "rating": dict(amazon=1 + part % 9 / 2, target=1 + part % 9 / 2),
            "product_rating": dict(walmart=(1 + part % 9 / 2).cast("string"), asos=F.lit("no rating")),
            "review_count": dict(amazon=reviews, walmart=reviews),
            "product_reviews_count": dict(target=part % 1000, footlocker=part % 1000),
            "sponsored": dict(amazon=F.when(flag == "R", True).when(flag == "A", False)),
            "is_sponsored": dict(walmart=F.when(flag == "R", "Yes ").when(flag == "A", "Sponsored"), asos=F.when(flag == "R", "TRUE").when(flag == "A", "no")),
            "is_promotion": dict(target=F.when(flag == "R", 1).when(flag == "A", 0)),
            "asin": dict(amazon=identity),
            "tcin": dict(target=part),
            "product_id": dict(walmart=identity, footlocker=identity, asos=identity),
            "product_url": dict(amazon=F.concat(F.lit("https://www.amazon.com/"), slug, F.lit("/dp/"), identity)),
            "url": dict(asos=F.concat(F.lit("https://asos.example.com/"), identity)),
            "product_out_of_stock": dict(walmart=F.when(stock == 1, True).when(stock == 2, False)),
            "availability": dict(target=F.when(stock == 1, "in_stock").when(stock == 2, "OUT").when(stock == 3, "")),
        }
    )
    # A JSON null, which to_json never writes, for a field that is there but unknown.
    # Bound, because the projection as part of one generated method would be longer than the JVM compiles.
    start = bind(
        F.col("shop"), lambda shop: F.when((shop == "walmart") & (stock == 3), '{"product_out_of_stock":null,').otherwise("{")
    )
    return joined.select(
        *ROW_KEY,
        F.col("shop").alias("retailer"),
        F.lower("p_type").alias("keyword"),
        F.concat(start, F.substring(item, 2, 1 << 30)).alias("item"),
    )


def payloads(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One search response per line item, in every shape a response comes in."""
    # What stands before and after the item in a response of each shape. The last two are the first two
    # with a string that looks like an object or a list.
    wraps = {
        0: ('{"entities":[', ',3,"t",null]}'),
        1: ('{"entities":3,"products":[', "]}"),
        2: ("[3,", "]"),
        3: ("", ""),
        4: ('{"entities":[],"products":[', "]}"),
        6: ('{"entities":[', ',3,"{\\"title\\":1}",null]}'),
        7: ('{"entities":"[1]","products":[', "]}"),
    }
    shape = F.col("l_orderkey") % 6
    wrap = F.when(F.col("l_orderkey") % 96 < 2, shape + 6).otherwise(shape)
    before = F.create_map(*[F.lit(v) for n, (text, _) in wraps.items() for v in (n, text)])
    after = F.create_map(*[F.lit(v) for n, (_, text) in wraps.items() for v in (n, text)])
    parsing = F.concat(before[wrap.cast("int")], "item", after[wrap.cast("int")])
    return items(spark, sf_dir, lineitem).select(
        *ROW_KEY,
        "retailer",
        "keyword",
        F.when(shape < 5, F.concat(F.lit('{"status":"ok","data":{"parsing":'), parsing, F.lit("}}")))
        .when(F.col("l_linenumber") % 2 == 0, '{"status":"ok","data":{}}')
        .otherwise("service unavailable")
        .alias("payload"),
    )


def value_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loosely typed JSON value per line item under ``a``, ``b`` and ``c``."""
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    number = F.concat((part % 200).cast("string"), F.lit("."), (line % 10).cast("string"))
    value = (
        F.when(part % 8 == 0, number)
        .when(part % 8 == 1, F.concat(F.lit("-"), number))
        .when(part % 8 == 2, F.concat(F.lit('"-$'), number, F.lit('"')))
        .when(part % 8 == 3, F.concat(F.lit('"'), number, F.lit(' - $59.99"')))
        .when(part % 8 == 4, "true")
        .when(part % 8 == 5, '"Yes "')
        .when(part % 8 == 6, "null")
        .otherwise('"N/A"')
    )
    before = F.when(line % 3 == 0, '"a":"","b":[],').when(line % 3 == 1, '"a":null,').otherwise("")
    return table(spark, sf_dir, "lineitem").select(
        *ROW_KEY, F.concat(F.lit("{"), before, F.lit('"c":'), value, F.lit("}")).alias("item")
    )


def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web search responses: a document is a hit with a long description, and a second without."""
    doc = F.col("doc_id").cast("string")
    hits = F.array(
        F.struct(
            F.concat(F.lit("Document "), doc).alias("title"),
            F.col("text").alias("description"),
            F.concat(F.lit("https://docs.example.com/"), doc).alias("url"),
            F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("source")).alias("content"),
        ),
        F.struct(
            F.col("source").alias("title"),
            F.lit(None).cast("string").alias("description"),
            F.lit(None).cast("string").alias("url"),
            F.col("lang").alias("content"),
        ),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(F.struct(hits.alias("results"))).alias("payload")
    )


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product-page items, one per part."""
    part = F.col("p_partkey")
    words = F.split("p_name", " ")
    page = F.struct(
        F.concat(F.lit("B0"), part.cast("string")).alias("asin"),
        F.col("p_name").alias("product_title"),
        F.when(part % 3 == 0, F.col("p_retailprice").cast("string"))
        .when(part % 3 == 1, F.concat(F.lit("$"), F.col("p_retailprice").cast("string")))
        .alias("web_price"),
        (1 + part % 9 / 2).alias("average_of_reviews"),
        F.when(part % 5 != 0, F.col("p_size").cast("string")).otherwise("many").alias("number_of_reviews"),
        F.struct(F.concat((part % 100).cast("string"), F.lit("%")).alias("5_star")).alias(
            "reviews_statistics_percentage_five_to_zero"
        ),
        F.when(part % 2 == 0, words).alias("review_mentions_with_positive_sentiment"),
        words.alias("review_mentions_with_neutral_sentiment"),
        F.col("p_type").alias("reviews_ai_summary"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(page).alias("item"))


def run_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to starting a research run, one per order."""
    key = F.col("o_orderkey")
    text_key = key.cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 5 == 1, 404).when(key % 5 != 2, 200).alias("http_code"),
        F.when(key % 5 == 1, F.concat(F.lit('{"detail":"no agent '), text_key, F.lit('"}')))
        .when(key % 5 == 3, "<html>busy</html>")
        .when(key % 5 != 2, F.concat(F.lit('{"id":"run_'), text_key, F.lit('","status":"queued"}')))
        .alias("body"),
        F.when(key % 5 == 2, F.repeat(F.concat(F.lit("timeout "), text_key, F.lit(" ")), 60)).alias("exception"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of research runs, one per order: rows in every shape, claims with repeated URLs."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    count = (customer % 12 + 1).cast("int")
    numbers = range(12)  # of the rows that a run has at most

    def texts(of: Callable[[int], str], these: Iterable[int] = numbers) -> Column:
        return F.array(*[F.lit(of(n)) for n in these])

    # Nothing in a row or claim needs escaping, so its JSON is put together from pieces, and what depends on small
    # numbers alone is a piece made once.
    dates = {0: lambda i: f'"quarter_end_date":"2025-0{i % 9 + 1}-15",', 1: lambda i: '"quarter_end_date":"soon",', 2: lambda i: ""}
    revenues = ['"revenue_millions":"n/a",', "", '"revenue_millions":"', '"revenue_millions":"']
    before = texts(lambda i: f'"fiscal_quarter_label":"Q{i % 4 + 1}",{dates[i % 3](i)}{revenues[i % 4]}')
    after = texts(lambda i: f'{"" if i % 4 < 2 else chr(34) + ","}"gross_margin_pct":{0.5 + i}}}')

    def row(i: Column) -> Column:
        company = F.concat(F.lit('{"company":"Company '), ((customer + i) % 50).cast("string"), F.lit('",'))
        revenue = F.when(i % 4 >= 2, (customer + i).cast("string")).otherwise("")
        return F.concat(F.when((key + i) % 7 != 0, company).otherwise("{"), F.get(before, i), revenue, F.get(after, i))

    rows = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), count - 1), row), ","), F.lit("]"))
    paths = F.concat(
        F.flatten(F.array_repeat(F.slice(texts(lambda i: f'{{"path":"$[{i}].field"'), F.lit(1), count), 3)),
        F.array(*[F.lit(f'{{"path":"{path}"') for path in ("$", "$[1][0]", "$[01]", "$.a", "$[10].x", "$[1]")]),
    )
    # A claim has a grade of four and a first URL of five, counted from the customer, and a second URL of three, counted
    # from 0: all in step with one number that is the customer's modulo 20 and 0 modulo 3 at the first claim.
    grades = [f',"confidence":"{grade}"' for grade in ("high", "high", "low")] + [""]
    ends = texts(
        lambda n: f'{grades[n % 4]},"citations":[{{"url":"https://a.example.com/{n % 5}"}},{{"url":""}},'
        f'{{"url":"https://b.example.com/{n % 3}"}}]}}',
        range(59 + 3 * len(numbers) + 6),
    )
    first = (customer % 20 * 21 % 60).cast("int")
    claims = F.zip_with(paths, F.slice(ends, first + 1, 3 * count + 6), lambda path, end: F.concat(path, end))
    content = (
        F.when(key % 4 == 0, rows)
        .when(key % 4 == 1, F.concat(F.when(key % 64 == 1, '{"meta":"[7]","rows":').otherwise('{"meta":1,"rows":'), rows, F.lit(',"also":[1]}')))
        .when((key % 4 == 2) & customer.isNotNull(), row(F.lit(0)))
    )
    graded = F.rtrim(F.substring(F.to_json(F.struct(F.col("o_orderpriority").alias("confidence"))), 2, 1 << 30), F.lit("}"))
    with_claims = F.concat(F.lit('"claims":['), F.array_join(claims, ","), F.lit("]"))
    trust = F.concat(F.lit("{"), F.concat_ws(",", F.nullif(graded, F.lit("")), with_claims), F.lit("}"))
    with_content = F.coalesce(F.concat(F.lit('"content":'), content, F.lit(",")), F.lit(""))
    # An envelope is a hundred times as long as its order, and a file of orders may be few tasks.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return orders.repartition(4 * spark.sparkContext.defaultParallelism).select(
        F.concat(F.lit("run_"), key.cast("string")).alias("run_id"),
        F.when(key % 10 == 9, "running").otherwise("completed").alias("status"),
        F.concat(F.lit('{"output":{'), with_content, F.lit('"trust":'), trust, F.lit("}}")).alias("envelope"),
    )


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Researched review rows as ``run_result`` gives them, one per part."""
    part = F.col("p_partkey")
    text = part.cast("string")
    fields = [
        F.when(part % 6 != 0, F.concat(F.lit('"brand":"'), "p_brand", F.lit('"'))),
        F.when(part % 7 == 0, F.lit('"model":null')).otherwise(F.concat(F.lit('"model":"'), "p_type", F.lit('"'))),
        F.when(part % 5 == 0, F.lit('"rating":"4.5"')).when(part % 5 == 1, F.lit('"rating":4.5')).when(part % 5 == 2, F.lit('"rating":"n/a"')),
        F.when(part % 4 == 0, F.concat(F.lit('"review_count":'), text, F.lit(".6")))
        .when(part % 4 == 1, F.concat(F.lit('"review_count":'), text))
        .when(part % 4 == 2, F.lit('"review_count":"4.0"'))
        .otherwise(F.concat(F.lit('"review_count":"'), text, F.lit('"'))),
        F.when(part % 3 == 0, F.lit('"top_praise":["light","fast"]')).when(part % 3 == 1, F.lit('"top_praise":null')),
    ]
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("run_"), text).alias("run_id"),
        F.lit("high").alias("confidence"),
        F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("item_json"),
        F.array(F.lit("https://a.example.com")).alias("source_urls"),
        F.lit(1.0).alias("high_confidence_share"),
        F.lit("[]").alias("claims_json"),
    )


def earnings_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several candidate rows per company and quarter, in mixed case, with NULLs. Sums go through
    DECIMAL, because a DOUBLE sum depends on the order of the rows."""
    when = F.col("o_orderdate")
    count = F.count(F.lit(1))
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(
            F.when(F.month(when) < 7, F.upper("n_name")).otherwise(F.lower("n_name")).alias("company"),
            F.concat(F.lit("Q"), F.quarter(when).cast("string")).alias("fiscal_quarter_label"),
            F.when(
                (F.col("c_nationkey") != 7) | (F.year(when) != 1998),
                F.date_trunc("quarter", when).cast("date"),
            ).alias("quarter_end_date"),
            F.col("o_orderpriority").alias("run_id"),
            "c_nationkey",
        )
        .agg(
            (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1000000).alias("revenue_millions"),
            (100 * F.avg(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))).alias("gross_margin_pct"),
            F.when(count % 7 != 0, 100 * F.avg(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)) - 33).alias("revenue_growth_yoy_pct"),
            F.when(count % 5 != 0, (count % 101).cast("double") / 100).alias("high_confidence_share"),
        )
        .drop("c_nationkey")
    )


EARNINGS_TIES = ["run_id", "fiscal_quarter_label", "company", "revenue_millions"]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review history, one row per part, loaded in the order of the part key."""
    part = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("model"),
        F.when(part % 13 != 0, 1 + (part % 9).cast("double") / 2).alias("rating"),
        (F.col("p_size") * 37).alias("review_count"),
        F.col("p_retailprice").alias("price_usd"),
        F.lit("shop").alias("retailer"),
        F.array(F.col("p_name")).alias("top_praise"),
        F.when(part % 4 != 0, F.array(F.get(F.split("p_name", " "), F.lit(0)))).alias("top_complaints"),
        F.concat(F.lit("https://shop.example.com/"), part.cast("string")).alias("product_url"),
        part.alias("loaded_at"),
        F.concat(F.lit("run_"), (part % 40).cast("string")).alias("run_id"),
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products to watch: brand and model of the parts."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.lit("daily trainer").alias("category")
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access log with nested fields, one row per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.col("ts").cast("date").alias("event_date"),
        F.struct(
            F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email")
        ).alias("user_identity"),
        F.when(F.col("event_type") == "error", "secrets").otherwise("gateway").alias("service_name"),
        F.col("event_type").alias("action_name"),
        F.struct(
            F.concat(F.lit("tool_"), (k % 5).cast("string")).alias("tool_name"),
            F.when(k % 2 == 0, "tools/call").otherwise("tools/list").alias("json_rpc_method"),
            F.when(k % 3 == 0, "server").alias("mcp_server_name"),
            F.when(k % 3 == 1, "connection").alias("connection_name"),
            F.concat(F.lit("scope_"), (k % 3).cast("string")).alias("scope"),
        ).alias("request_params"),
        F.struct(F.when(k % 10 == 0, 500).otherwise(200).alias("status_code")).alias("response"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of many runs, one row per claim, each citing a page."""
    k = F.col("k")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    cited = F.col("event_id") % pages.agg(F.count(F.lit(1))).scalar()
    row = F.concat(F.lit("$["), (k % 12).cast("string"))
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .withColumn("cited", cited)
        .join(pages, F.col("page_id") == F.col("cited"))
        .select(
            F.col("user_id").alias("run_id"),
            F.col("event_id").alias("claim_pos"),
            F.when(k < 10, "$")
            .when(k < 20, F.concat(row, F.lit("][0]")))
            .when(F.col("event_type") == "view", F.concat(row, F.lit("]")))
            .otherwise(F.concat(row, F.lit("]."), "event_type"))
            .alias("path"),
            F.when((k % 4).isin(0, 1), "high").when(k % 4 == 2, "low").alias("confidence"),
            F.when(k % 9 == 0, "").otherwise(F.col("url")).alias("url"),
        )
    )


def run_events(events: DataFrame) -> DataFrame:
    """Status events of research runs: a user is a label with three runs."""
    return events.select(
        F.col("user_id").cast("string").alias("label"),
        F.concat_ws("_", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")).alias("run_id"),
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "signup", "cancelled")
        .otherwise("running")
        .alias("status"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )
