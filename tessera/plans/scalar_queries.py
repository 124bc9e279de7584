"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as s
from tessera.plans.registry import Registry, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
c = F.col


@R.add(
    "scalar_numbers",
    """SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS root, round(sin(l_quantity), 6) AS sine, round(atan2(l_quantity, l_tax + 1), 6) AS angle,
    round(log(l_quantity) / log(2), 6) AS lg, ceil(l_tax * 10)::BIGINT AS up, degrees(l_discount).round(6) AS deg, l_quantity BETWEEN 5 AND 9 AS mid,
    CASE WHEN l_linenumber = 3 THEN 0 WHEN l_linenumber < 3 THEN -1 ELSE 1 END AS cmp, (l_orderkey & 6)::BIGINT AS bits FROM lineitem""",
)
def numbers(spark, sf_dir):
    f = s.FUNCTIONS
    q = c("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(f["sqrt"](q), 6).alias("root"), F.round(f["sin"](q), 6).alias("sine"),
            F.round(f["arctan2"](q, c("l_tax") + 1), 6).alias("angle"),
        F.round(s.log_base(q, 2), 6).alias("lg"), f["ceil"](c("l_tax") * 10).alias("up"), F.round(f["rad2deg"](c("l_discount")), 6).alias("deg"),
            s.between(q, 5, 9).alias("mid"),
        s.compare(c("l_linenumber"), F.lit(3)).alias("cmp"), s.bit_and(c("l_orderkey"), F.lit(6).cast("long")).alias("bits"),
    )


@R.add(
    "scalar_texts",
    """SELECT p_partkey, substr(p_name, 2, 4) AS part, strpos(p_name, 'e')::INT AS at, replace(p_name, 'a', 'AA') AS rep, upper(p_type) AS up, levenshtein(p_name, p_type)::INT AS d,
    starts_with(p_brand, 'Brand#1') AS s, regexp_full_match(p_brand, 'Brand#[1-3]+') AS m, md5(p_name) AS h, TRY_CAST(p_brand AS DOUBLE) AS r,
    len(string_split(p_type, ' '))::INT AS words FROM part""",
)
def texts(spark, sf_dir):
    name, brand, kind = c("p_name"), c("p_brand"), c("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", s.substring(name, 2, 5).alias("part"), s.find(name, "e").alias("at"), s.replace(name, "a", "AA").alias("rep"), F.upper(kind).alias("up"),
            s.FUNCTIONS["ldistance"](name, kind).alias("d"),
        s.starts_with(brand, "Brand#1").alias("s"), s.regex_matches(brand, "Brand#[1-3]+").alias("m"), s.FUNCTIONS["md5"](name).alias("h"),
            s.text_to_real(brand).alias("r"), F.size(s.tokenize(kind, " ")).alias("words"),
    )


@R.add("keywords", r"""SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9A-Za-z_]+')) AS w FROM documents) GROUP BY w""")
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(s.keywords(c("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@R.add(
    "scalar_instants",
    """SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, dayname(o_orderdate) AS w,
    (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap,
    round(epoch(o_orderdate - TIMESTAMP '2000-01-03') / 86400, 6) AS days,
    round(epoch(o_orderdate - TIMESTAMP '1995-01-01 12:00:00') / 86400, 6) AS since FROM orders""",
)
def instants(spark, sf_dir):
    t = c("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("d"), s.weekday_of(t).alias("w"), s.leap_year(F.year(t)).alias("leap"),
        F.round(s.instant_to_real(t), 6).alias("days"), F.round(s.duration_to_real(t - s.the_instant(1995, 1, 1, 12)), 6).alias("since"),
    )


@R.add(
    "collections",
    """WITH g AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderkey % 7))) AS xs, list_sort(list_distinct(list(o_orderkey % 5))) AS ys FROM orders GROUP BY o_custkey)
    SELECT o_custkey, len(xs)::INT AS n, list_contains(xs, 3) AS has, len(list_distinct(list_concat(xs, ys)))::INT AS u, len(list_intersect(xs, ys))::INT AS i,
    list_min(list_intersect(xs, ys)) AS least, list_sum(xs)::BIGINT AS total FROM g""",
)
def collections(spark, sf_dir):
    k = c("o_orderkey")
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(k % 7)).alias("xs"), F.array_sort(F.collect_set(k % 5)).alias("ys"))
    xs, ys = c("xs"), c("ys")
    return g.select(
        "o_custkey", F.size(xs).alias("n"), s.collection_contains(xs, 3).alias("has"), F.size(s.set_union(xs, ys)).alias("u"),
            F.size(s.set_intersection(xs, ys)).alias("i"),
        s.min_common(xs, ys).alias("least"), s.tie(xs, lambda a, b: a + b).alias("total"),
    )


@R.add(
    "rectangles",
    """WITH b AS (SELECT p_partkey, p_size::DOUBLE AS x1, p_size + p_partkey % 5 + 1.0 AS x2, p_partkey % 20 + 0.0 AS y1, p_partkey % 20 + 3.0 AS y2 FROM part)
    SELECT p_partkey, (x1 <= 20 AND x2 >= 10 AND y1 <= 9 AND y2 >= 4) AS meets, (x1 >= 10 AND x2 <= 20 AND y1 >= 4 AND y2 <= 9) AS within_,
    (x2 - x1) * (y2 - y1) AS area,
    2 * (x2 - x1 + y2 - y1) AS around, round(sqrt(pow(greatest(x1 - 20, 10 - x2, 0), 2) + pow(greatest(y1 - 9, 4 - y2, 0), 2)), 6) AS away FROM b""",
)
def rectangles(spark, sf_dir):
    size, k = c("p_size").cast("double"), c("p_partkey")
    box, window = s.rectangle(size, size + k % 5 + 1.0, k % 20, k % 20 + 3.0), s.rectangle(10, 20, 4, 9)
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("a")).select(
        "p_partkey", s.rect_intersects(c("a"), window).alias("meets"), s.rect_inside(c("a"), window).alias("within_"), s.rect_size(c("a")).alias("area"),
        s.perimeter(c("a")).alias("around"), F.round(s.rect_distance(c("a"), window), 6).alias("away"),
    )


@R.add("dice_links", "SELECT page_id, length(html)::INT AS n, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::INT AS links FROM pages")
def dice_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n"),
        F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("links"))


NUMBER_SQL = """SELECT l_orderkey, l_linenumber, round(cos(l_quantity), 6) AS cosine, round(tan(l_tax), 6) AS tangent, round(asin(l_tax), 6) AS arcsine, round(acos(l_tax), 6) AS arccosine,
    round(atan(l_quantity), 6) AS arctangent, round(radians(l_quantity), 6) AS rad, round(pow(l_tax, 3), 6) AS cube, round(ln(l_quantity), 6) AS nat,
    abs(l_linenumber - 4)::INT AS away,
    floor(l_extendedprice / 7)::BIGINT AS low, l_linenumber::DOUBLE AS realnum, trunc(l_extendedprice)::INT AS whole, (l_linenumber % 2)::BOOLEAN AS odd,
    (l_linenumber > 3)::INT AS flag,
    l_linenumber::VARCHAR AS shown, l_linenumber + 1 AS next_, CASE WHEN l_tax > 0.03 THEN 'high' ELSE 'low' END AS level, CASE WHEN l_linenumber = 1
    THEN 'first' WHEN l_linenumber < 4 THEN 'some' ELSE 'rest' END AS place,
    CASE WHEN l_linenumber <> 2 THEN l_linenumber END AS without2, CASE WHEN l_linenumber = 2 THEN l_linenumber END AS only2,
    l_linenumber IS NOT NULL AS known, isnan(l_tax) AS nan_,
    round(l_linenumber + l_quantity / 60 + l_tax / 3600, 6) AS degree, round(pi() + exp(1), 6) AS constants, false AS empty_,
    (('0x' || substr(md5('3:' || l_orderkey::VARCHAR), 1, 13))::BIGINT % 10)::BIGINT AS dice_, 2147483647 AS top, -2147483648 AS bottom, true AS checked
    FROM lineitem"""


@R.add("scalar_numbers2", NUMBER_SQL)
def numbers2(spark, sf_dir):
    f = s.FUNCTIONS
    q, tax, n, price = c("l_quantity"), c("l_tax"), c("l_linenumber"), c("l_extendedprice")
    six = lambda x: F.round(x, 6)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", six(f["cos"](q)).alias("cosine"), six(f["tan"](tax)).alias("tangent"), six(f["arcsin"](tax)).alias("arcsine"),
            six(f["arccos"](tax)).alias("arccosine"),
        six(f["arctan"](q)).alias("arctangent"), six(f["deg2rad"](q)).alias("rad"), six(f["pow"](tax, F.lit(3))).alias("cube"), six(f["log"](q)).alias("nat"),
            f["abs"](n - 4).cast("int").alias("away"),
        f["floor"](price / 7).alias("low"), f["int2real"](n).alias("realnum"), f["real2int"](price).alias("whole"), f["int2bool"](n % 2).alias("odd"),
            f["bool2int"](n > 3).alias("flag"),
        f["num2string"](n).alias("shown"), f["increment"](n).alias("next_"), f["ifthenelse"](tax > 0.03, F.lit("high"), F.lit("low")).alias("level"),
        f["switch"]((n == 1, F.lit("first")), (n < 4, F.lit("some")), default="rest").alias("place"), f["minus"](n, F.lit(2)).alias("without2"),
            f["intersection"](n, F.lit(2)).alias("only2"),
        f["isdefined"](n).alias("known"), f["isnan"](tax).alias("nan_"), six(f["dms2deg"](n, q, tax)).alias("degree"),
            six(f["const_pi"]() + f["const_e"]()).alias("constants"), f["isempty"](n).alias("empty_"),
        s.seeded(3)(10, c("l_orderkey")).alias("dice_"), f["getMaxVal"]("int").alias("top"), f["getMinVal"]("int").alias("bottom"),
            f["assert"](n > 0).alias("checked"),
    )


@R.add(
    "hashvalue_spread",
    "SELECT count(DISTINCT o_orderkey)::BIGINT AS n, true AS within_, 100::BIGINT AS cells FROM orders",
)
def hash_value_spread(spark, sf_dir):
    """Hashes are from 0 to n - 1, equal for equal keys, and reach every cell."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", s.hash_value(c("o_orderkey"), 100).alias("h"))
    return rows.agg(F.countDistinct("o_orderkey", "h").alias("n"), (F.bool_and(c("h").between(0, 99))).alias("within_"), F.countDistinct("h").alias("cells"))


@R.add(
    "scalar_texts2",
    r"""WITH t AS (SELECT *, p_type || '.  ' || p_name || '! end' AS txt FROM part)
    SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, trim('  ' || p_name || ' ') AS trimmed, contains(p_type, 'STEEL') AS has, ends_with(p_type,
    'TIN') AS tin, lower(p_name) = lower(upper(p_name)) AS same,
    p_partkey::VARCHAR AS key_, chr((65 + p_partkey % 26)::INT) AS letter, regexp_matches(p_brand, '^(?:Brand#[12])') AS begins, CASE
    WHEN regexp_matches(p_brand, '#[0-9]') THEN strpos(p_brand, '#')::INT ELSE 0 END AS at,
    p_name LIKE 'a%' AS liked, regexp_replace(trim('  a   ' || p_name || ' '), '\s+', ' ', 'g') AS squeezed, nullif(trim(regexp_replace('   ', '\s+', ' ',
    'g')), '') AS nothing, 'gz' AS ext, 'a\\b' AS masked,
    regexp_replace(p_brand, '([0-9]+)', '<\1>', 'g') AS marked, TRY_CAST(substr(p_brand, 7) AS INT) AS num, chr(10) AS newline, p_name AS again,
    len(string_split_regex(txt, '[.!?]\s+'))::INT AS parts,
    '$5s$ab$' || sha256('ab' || p_name) AS secret, true AS good, false AS bad,
    2.0 * len(list_intersect(list_distinct(list_transform(range(1, greatest(len(p_name), 2)), lambda i: substr(p_name, i, 2))),
    list_distinct(list_transform(range(1, greatest(len(p_type), 2)), lambda i: substr(p_type, i, 2)))))
    / (len(list_distinct(list_transform(range(1, greatest(len(p_name), 2)), lambda i: substr(p_name, i, 2)))) + len(list_distinct(list_transform(range(1,
    greatest(len(p_type), 2)), lambda i: substr(p_type, i, 2))))) AS dice_ FROM t""",
)
def texts2(spark, sf_dir):
    f = s.FUNCTIONS
    name, brand, kind = c("p_name"), c("p_brand"), c("p_type")
    secret = f["crypt"](name, "ab")
    return table(spark, sf_dir, "part").select(
        "p_partkey", f["toupper"](name).alias("up"), f["tolower"](kind).alias("low"), f["trim"](F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
            f["contains"](kind, "STEEL").alias("has"),
        f["endsWith"](kind, "TIN").alias("tin"), f["strequal"](name, F.upper(name), True).alias("same"), f["tostring"](c("p_partkey")).alias("key_"),
            f["char"]((65 + c("p_partkey") % 26).cast("int")).alias("letter"),
        f["startsReg"](brand, f["createRegEx"]("Brand#[12]")).alias("begins"), f["findPattern"](brand, "#[0-9]").alias("at"),
            f["like2regex"](name, "a%").alias("liked"),
        f["trimAll"](F.concat(F.lit("  a   "), name, F.lit(" "))).alias("squeezed"), f["trimAllUndef"](F.lit("   ")).alias("nothing"),
            f["fileExtension"](F.lit("dir.x/file.tar.gz")).alias("ext"),
        f["maskBackslash"](F.lit("a\\b")).alias("masked"), f["markText"](brand, "[0-9]+", "<", ">").alias("marked"),
            f["str2int"](f["substr"](brand, 7, 99)).alias("num"), f["endl"]().alias("newline"),
        f["recode"](name, "UTF-8", "UTF-8").alias("again"), F.size(f["sentences"](F.concat(kind, F.lit(".  "), name, F.lit("! end")))).alias("parts"),
        secret.alias("secret"), f["checkpw"](name, secret).alias("good"), f["checkpw"](brand, secret).alias("bad"), f["dice"](name, kind).alias("dice_"),
    )


@R.add(
    "scalar_instants2",
    """WITH t AS (SELECT o_orderkey, o_orderdate::TIMESTAMP + to_milliseconds((o_orderkey * 977) % 86400000) AS t FROM orders)
    SELECT o_orderkey, hour(t)::INT AS h, minute(t)::INT AS m, second(t)::INT AS s, (millisecond(t) % 1000)::BIGINT AS ms, t + INTERVAL 36 HOUR AS later,
    t < TIMESTAMP '1995-06-17' AS early,
    round(epoch(t - TIMESTAMP '1990-01-01') / 86400 / 2, 6) AS half, (epoch_ms(t - TIMESTAMP '1990-01-01') // 86400000)::BIGINT AS days, strptime(strftime(t,
    '%d.%m.%Y'), '%d.%m.%Y') AS parsed,
    make_date(year(t), month(t), 1) AS first_, CAST(strftime(t, '%Y-%m-%d') AS DATE) AS day_,
    TIMESTAMP '2000-01-03' + to_days((o_orderkey % 100)::INT) + to_milliseconds(1500) AS made,
    abs(o_orderkey % 7 - 3)::BIGINT AS size_, TIMESTAMP '0001-01-01' < t AS above, t < TIMESTAMP '9999-12-31 23:59:59.999999' AS below, true AS spans FROM t""",
)
def instants2(spark, sf_dir):
    f = s.FUNCTIONS
    k = c("o_orderkey")
    t = (F.timestamp_micros(F.unix_micros(c("o_orderdate").cast("timestamp")) + (k * 977) % 86_400_000 * 1000)).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))
    t, since = c("t"), c("t") - s.the_instant(1990)
    day = f["create_duration"](1)
    return rows.select(
        "o_orderkey", f["hour_of"](t).alias("h"), f["minute_of"](t).alias("m"), f["second_of"](t).alias("s"), f["millisecond_of"](t).alias("ms"),
            (t + f["create_duration"](1, 43_200_000)).alias("later"),
        (t < s.the_instant(1995, 6, 17)).alias("early"), F.round(s.duration_to_real(since / 2), 6).alias("half"), f["duration_div"](since, day).alias("days"),
        f["transformDateTime"](F.date_format(t, "dd.MM.yyyy"), "dd.MM.yyyy").alias("parsed"), f["thedate"](F.year(t), F.month(t), F.lit(1)).alias("first_"),
            f["str2date"](F.date_format(t, "yyyy-MM-dd")).alias("day_"),
        f["create_instant"]((k % 100).cast("int"), 1500).alias("made"),
            F.abs(F.extract(F.lit("DAY"), f["abs_duration"](f["create_duration"]((k % 7 - 3).cast("int"))))).cast("long").alias("size_"),
        (f["mininstant"]() < t).alias("above"), (t < f["maxnstant"]()).alias("below"),
            ((f["minduration"]() < day) & (day < f["maxduration"]()) & (f["today"]() >= F.lit("2020-01-01").cast("date")) & (f["now"]() >= F.lit("2020-01-01").cast("timestamp"))).alias("spans"),
    )


@R.add(
    "collections2",
    """WITH g AS (SELECT o_custkey, list_sort(list(o_orderkey % 7)) AS xs, list_sort(list_distinct(list(o_orderkey % 5))) AS ys FROM orders GROUP BY o_custkey)
    SELECT o_custkey, [o_custkey, 3, 3] AS vec, CASE WHEN o_custkey = 3 THEN [3] ELSE list_sort([o_custkey, 3]) END AS set_, list_sort([3, o_custkey,
    3]) AS multi, xs[2] AS second,
    list_filter(xs, lambda x: x <> 2) AS without2, list_sort(list_filter(ys, lambda y: NOT list_contains(xs, y))) AS only_y, list_contains(ys, 4) AS has4,
    list_concat(xs, ys) AS both_,
    list_transform(xs, lambda x: x * x) AS squares, list_transform(range(1, len(xs) + 1), lambda i: list_sum(xs[1:i])::BIGINT) AS sums,
    list_reverse_sort(xs) AS back,
    list_concat([99], xs[2:]) AS put0, list_sort(list_distinct(list_append(ys, 77))) AS more, [0.5, 1.5] AS made FROM g""",
)
def collections2(spark, sf_dir):
    f = s.FUNCTIONS
    k = c("o_orderkey")
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(f["collect_multiset"](k % 7).alias("xs"), f["collect_set"](k % 5).alias("ys"))
    xs, ys, who = c("xs"), c("ys"), c("o_custkey")
    three = F.lit(3).cast("long")
    return g.select(
        "o_custkey", f["create_vector"](who, three, three).alias("vec"), f["create_set"](who, three, three).alias("set_"),
            f["create_multiset"](three, who, three).alias("multi"), f["get"](xs, F.lit(1)).alias("second"),
        f["deleteelem"](xs, F.lit(2).cast("long")).alias("without2"), f["difference"](ys, xs).alias("only_y"), f["in"](F.lit(4).cast("long"), ys).alias("has4"),
            f["concat_vectors"](xs, ys).alias("both_"),
        f["loop"](xs, lambda x: x * x).alias("squares"), f["cumulate"](xs, lambda a, b: a + b).alias("sums"), f["sortarray"](xs, lambda x: -x).alias("back"),
        f["put"](xs, F.lit(99).cast("long"), 0).alias("put0"), s.insert_element(ys, F.lit(77).cast("long"), True).alias("more"),
            f["makearray"](0.5, 1.5).alias("made"),
    )


@R.add(
    "rectangles2",
    """WITH b AS (SELECT p_partkey, p_size::DOUBLE AS x1, p_size + p_partkey % 5 + 1.0 AS x2, p_partkey % 20 + 0.0 AS y1, p_partkey % 20 + 3.0 AS y2 FROM part)
    SELECT p_partkey, x1 AS mind, y2 AS maxd, [y1, x1] AS plo, [x1 - 2, y1 - 2] AS elo, [x2 + 2, y2 + 2] AS ehi, [x1 * 2, y1 * 0.5] AS slo, [x1 + 1,
    y1 - 1] AS tlo,
    [least(x1, 10), least(y1, 4)] AS ulo, CASE WHEN x1 <= 20 AND x2 >= 10 AND y1 <= 9 AND y2 >= 4 THEN [least(x2, 20), least(y2, 9)] END AS ihi,
    list_sort(flatten(list_transform(range(floor(y1 / 5)::BIGINT, floor(y2 / 5)::BIGINT + 1), lambda y: list_transform(range(least(floor(x1 / 10), 3)::BIGINT,
    least(floor(x2 / 10), 3)::BIGINT + 1), lambda x: y * 4 + x + 1)))) AS cells,
    (x1 <= 20 AND x2 >= 10 AND y1 <= 9 AND y2 >= 4) AND floor(greatest(y1, 4) / 5) * 4 + least(floor(greatest(x1, 10) / 10), 3) + 1 = 6 AS own6,
    (CASE WHEN x2 >= 20 THEN 1 ELSE 0 END + CASE WHEN y2 >= 9 THEN 2 ELSE 0 END)::INT AS class_, (x2 < 20 AND y2 < 9) AS report,
    [10.0 * ((p_partkey % 7) % 4), 5.0 * ((p_partkey % 7) // 4)] AS glo, [x1 + (x2 - x1) / 2, y1] AS part2 FROM b""",
)
def rectangles2(spark, sf_dir):
    f = s.FUNCTIONS
    size, k = c("p_size").cast("double"), c("p_partkey")
    box, window = s.rectangle(size, size + k % 5 + 1.0, k % 20, k % 20 + 3.0), s.rectangle(10, 20, 4, 9)
    a, grid = c("a"), (0.0, 0.0, 10.0, 5.0, 4)
    kinds = f["toprightclass"](a, window)
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("a")).select(
        "p_partkey", f["minD"](a, 1).alias("mind"), f["maxD"](a, 2).alias("maxd"), f["rectproject"](a, 2, 1)["lo"].alias("plo"),
            f["enlargeRect"](a, 2.0)["lo"].alias("elo"), f["extendGeo"](a, 2.0)["hi"].alias("ehi"),
        f["scalerect"](a, 2, 0.5)["lo"].alias("slo"), f["rect_translate"](a, 1, -1)["lo"].alias("tlo"),
            s.OVERLOADED["union"]["struct"](a, window)["lo"].alias("ulo"), s.OVERLOADED["intersection"]["struct"](a, window)["hi"].alias("ihi"),
        F.array_sort(f["cellnumber"](a, *grid)).alias("cells"), f["gridintersects"](a, window, F.lit(6), *grid).alias("own6"), kinds.alias("class_"),
        f["toprightreport"](kinds, kinds).alias("report"), f["gridcell2rect"](k % 7 + 1, *grid)["lo"].alias("glo"),
            F.get(f["partitionRect"](a, 2, 1), F.lit(1))["lo"].alias("part2"),
    )
