"""Scalar functions by the names of the query language: numbers, logic, texts, instants and durations, collections, rectangles.

All take and give Columns and stay in generated code; undefined arguments give an undefined result unless stated otherwise. FUNCTIONS
maps each name to its function, for the query language.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def named(*names: str):
    def keep(f):
        for n in names or (f.__name__,):
            FUNCTIONS[n] = f
        return f

    return keep


def literal(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _value(x: object) -> object:
    """A Python value where one is needed."""
    return x


# Numbers and logic

FUNCTIONS |= {
    "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arctan2": F.atan2,
    "rad2deg": F.degrees, "deg2rad": F.radians, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "isnan": F.isnan, "pow": F.pow,
    "log": F.ln, "ln": F.ln, "length": F.length, "ldistance": F.levenshtein, "toupper": F.upper, "tolower": F.lower, "trim": F.trim,
        "md5": lambda s: F.md5(s.cast("binary")),
}


@named("round")
def round_(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


@named("logB")
def log_base(x: Column, base: float) -> Column:
    return F.log(float(base), x)


@named("const_pi")
def pi() -> Column:
    return F.pi()


@named("const_e")
def e() -> Column:
    return F.e()


@named("isdefined")
def is_defined(x: Column) -> Column:
    return x.isNotNull()


@named("isempty")
def is_empty(x: Column) -> Column:
    """Undefined, or a text of no length."""
    return x.isNull() | (F.length(x.cast("string")) == 0)


@named("between")
def between(x: Column, lo: object, hi: object) -> Column:
    return x.between(lo, hi)


@named("compare")
def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; undefined is the least."""
    return F.when(a.eqNullSafe(b), 0).when(a.isNull() | (a < b), -1).otherwise(1)


@named("ifthenelse")
def if_then_else(test: Column, a: object, b: object) -> Column:
    """b also where the test is undefined."""
    return F.when(test, a).otherwise(b)


@named("switch")
def switch(*cases: tuple[Column, object], default: object = None) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.lit(default))


@named("minus")
def scalar_minus(a: Column, b: Column) -> Column:
    """Set difference of scalars: a, or undefined where they are equal."""
    return F.when(~a.eqNullSafe(b), a)


@named("intersection")
def scalar_intersection(a: Column, b: Column) -> Column:
    return F.when(a == b, a)


@named("int2real")
def to_real(x: Column) -> Column:
    return x.cast("double")


@named("real2int", "bool2int")
def to_int(x: Column) -> Column:
    return x.cast("int")


@named("int2bool")
def to_bool(x: Column) -> Column:
    return x.cast("boolean")


@named("num2string", "svg2text", "text2svg", "filepath2text", "text2filepath", "totext", "tostring", "chartext", "attr2text", "toString", "charToText")
def to_text(x: Column) -> Column:
    return x.cast("string")


@named("str2real")
def text_to_real(x: Column) -> Column:
    """Undefined where the text isn't a number."""
    return x.try_cast("double")


@named("str2int")
def text_to_int(x: Column) -> Column:
    return x.try_cast("int")


@named("binand")
def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


@named("hashvalue")
def hash_value(x: Column, n: int) -> Column:
    """A hash from 0 to n - 1."""
    return F.pmod(F.xxhash64(x), F.lit(n))


@named("randint", "randmax")
def random_int(n: object, key: Column | None = None, seed: int = 0) -> Column:
    """0 to n - 1: by hash of a key and the seed, so the same at every run, or without a key by Spark's seeded generator."""
    if key is None:
        return F.floor(F.rand(seed) * n).cast("long")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long"), literal(n).cast("long"))


@named("randseed", "seqinit")
def seeded(seed: int) -> Callable[..., Column]:
    """A generator for that seed: seeded(7)(10, key). There is no global state."""
    return lambda n, key=None: random_int(n, key, seed)


@named("increment")
def increment(x: Column) -> Column:
    """x++: the successor."""
    return x + 1


@named("assert")
def assert_true(test: Column) -> Column:
    """true, or the query ends with an error."""
    return F.assert_true(test).isNull()


_BOUNDS = {"int": (-(1 << 31), (1 << 31) - 1), "longint": (-(1 << 63), (1 << 63) - 1), "real": (-1.7976931348623157e308, 1.7976931348623157e308),
    "bool": (False, True)}


@named("getMinVal")
def least_value(kind: str) -> Column:
    """The least value of a type: int, longint, real or bool."""
    return F.lit(_BOUNDS[kind][0])


@named("getMaxVal")
def greatest_value(kind: str) -> Column:
    return F.lit(_BOUNDS[kind][1])


@named("dms2deg")
def dms_to_degrees(d: Column, m: Column, s: Column, north_or_east: object = True) -> Column:
    return F.when(literal(north_or_east), 1).otherwise(-1) * (d + m / 60 + s / 3600)


# Texts


@named("contains")
def contains(a: Column, b: object) -> Column:
    return a.contains(b)


@named("substr", "subtext", "substrw")
def substring(s: Column, first: int, last: int) -> Column:
    """Characters first to last, counted from 1, both included."""
    return F.substring(s, first, max(0, last - first + 1))


@named("find")
def find(s: Column, part: str) -> Column:
    """Position from 1, 0 if it isn't there."""
    return F.locate(part, s)


@named("replace")
def replace(s: Column, old: object, new: object) -> Column:
    return F.replace(s, literal(old), literal(new))


@named("keywords")
def keywords(s: Column) -> Column:
    """Words (letters, digits, underscores) as an array."""
    return F.regexp_extract_all(s, F.lit(r"\w+"), F.lit(0))


@named("sentences")
def sentences(s: Column) -> Column:
    """Stretches that end in . ! or ?, trimmed, as an array."""
    return F.filter(F.transform(F.split(s, r"(?<=[.!?])\s+"), F.trim), lambda x: x != "")


@named("tokenize")
def tokenize(s: Column, separators: str) -> Column:
    """Pieces between any of the separator characters, as an array."""
    import re

    return F.filter(F.split(s, f"[{re.escape(separators)}]"), lambda x: x != "")


@named("dice")
def dice(a: Column, b: Column, n: int = 2) -> Column:
    """Dice coefficient of the sets of n-grams of characters."""
    grams = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))),
        lambda i: s.substr(i, F.lit(n))))
    x, y = grams(a), grams(b)
    return 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


@named("startsWith", "starts")
def starts_with(s: Column, part: object) -> Column:
    return s.startswith(part)


@named("endsWith")
def ends_with(s: Column, part: object) -> Column:
    return s.endswith(part)


@named("strequal")
def text_equal(a: Column, b: Column, ignore_case: bool = False) -> Column:
    return F.lower(a) == F.lower(b) if ignore_case else a == b


@named("regexmatches")
def regex_matches(s: Column, pattern: str) -> Column:
    """The whole text matches."""
    return s.rlike(f"^(?:{pattern})$")


@named("startsReg")
def starts_regex(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})")


@named("findPattern")
def find_pattern(s: Column, pattern: str) -> Column:
    """Position of the first match from 1, 0 if there is none."""
    return F.regexp_instr(s, F.lit(pattern))


@named("like2regex")
def like(s: Column, pattern: str) -> Column:
    return s.like(pattern)


@named("trimAll")
def trim_all(s: Column) -> Column:
    """Runs of blanks become one; none at the ends."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


@named("trimAllUndef")
def trim_all_undefined(s: Column) -> Column:
    """As trimAll; an empty result is undefined."""
    return F.nullif(trim_all(s), F.lit(""))


@named("fileExtension")
def file_extension(s: Column) -> Column:
    return F.regexp_extract(s, r"\.([^./\\]*)$", 1)


@named("maskBackslash")
def mask_backslash(s: Column) -> Column:
    return F.replace(s, F.lit("\\"), F.lit("\\\\"))


@named("markText")
def mark_text(s: Column, pattern: str, before: str, after: str) -> Column:
    return F.regexp_replace(s, f"({pattern})", f"{before}$1{after}")


@named("char")
def char(code: Column) -> Column:
    return F.chr(code)


@named("endl")
def line_end() -> Column:
    return F.lit("\n")


@named("recode")
def recode(s: Column, source: str, target: str) -> Column:
    """Bytes of the text in one character set, read as another."""
    return F.decode(F.encode(s, source), target)


@named("createRegEx", "createRegEx2")
def pattern(text: str) -> str:
    """A checked regular expression, for the functions that take one."""
    import re

    re.compile(text)
    return text


@named("crypt")
def crypt(s: Column, salt: str = "") -> Column:
    """A salted one-way hash of a password, with its salt in front: $5s$salt$digest."""
    return F.concat(F.lit(f"$5s${salt}$"), F.sha2(F.concat(F.lit(salt), s), 256))


@named("checkpw")
def check_password(s: Column, hashed: Column) -> Column:
    """Whether crypt() of the text with the hash's own salt gives the hash."""
    parts = F.split(hashed, r"\$")
    return (F.size(parts) == 4) & (F.get(parts, F.lit(1)) == "5s") & (F.sha2(F.concat(F.get(parts, F.lit(2)), s), 256) == F.get(parts, F.lit(3)))


# Instants and durations

FUNCTIONS |= {"year_of": F.year, "month_of": F.month, "day_of": F.dayofmonth, "hour_of": F.hour, "minute_of": F.minute, "second_of": F.second,
    "now": F.current_timestamp, "today": F.current_date}


@named("weekday_of")
def weekday_of(t: Column) -> Column:
    return F.date_format(t, "EEEE")


@named("millisecond_of")
def millisecond_of(t: Column) -> Column:
    return F.pmod(F.unix_millis(t.cast("timestamp")), F.lit(1000))


@named("leapyear")
def leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


@named("theInstant")
def the_instant(year: object, month: object = 1, day: object = 1, hour: object = 0, minute: object = 0, second: object = 0, millisecond: object = 0) -> Column:
    return F.make_timestamp_ntz(*(literal(x) for x in (year, month, day, hour, minute)), literal(second) + literal(millisecond) / 1000)


@named("create_duration")
def create_duration(days: object, milliseconds: object = 0) -> Column:
    return F.make_dt_interval(literal(days), F.lit(0), F.lit(0), (literal(milliseconds) / 1000).cast("decimal(18,6)"))


@named("duration2real")
def duration_to_real(d: Column) -> Column:
    """Days."""
    micros = F.extract(F.lit("DAY"), d) * 86_400 + F.extract(F.lit("HOUR"), d) * 3600 + F.extract(F.lit("MINUTE"), d) * 60 + F.extract(F.lit("SECOND"), d)
    return micros.cast("double") / 86_400


@named("instant2real")
def instant_to_real(t: Column) -> Column:
    """Days since 2000-01-03, the zero of instants."""
    return (F.unix_micros(t.cast("timestamp")) - 946_857_600_000_000) / 86_400e6


@named("thedate")
def the_date(y: Column, m: Column, d: Column) -> Column:
    return F.make_date(literal(y), literal(m), literal(d))


@named("str2date")
def text_to_date(s: Column) -> Column:
    return F.try_to_date(s, "yyyy-MM-dd")


@named("duration_div")
def duration_div(a: Column, b: Column) -> Column:
    """How often a duration goes into another, as a whole number."""
    micros = lambda d: F.round(duration_to_real(d) * 86_400_000_000).cast("long")
    return F.floor(micros(a) / micros(b)).cast("long")


@named("abs_duration")
def abs_duration(d: Column) -> Column:
    return F.when(d < F.make_dt_interval(F.lit(0)), -d).otherwise(d)


@named("transformDateTime")
def parse_instant(s: Column, pattern: str) -> Column:
    return F.try_to_timestamp(s, F.lit(pattern)).cast("timestamp_ntz")


@named("create_instant")
def instant_of(day: object, millisecond: object = 0) -> Column:
    """The instant so many days after 2000-01-03, the zero of instants, and milliseconds after that day's begin."""
    micros = (literal(day).cast("long") * 86_400_000 + literal(millisecond).cast("long")) * 1000 + 946_857_600_000_000
    return F.timestamp_micros(micros).cast("timestamp_ntz")


@named("mininstant")
def least_instant() -> Column:
    return F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")


@named("maxnstant", "maxinstant")
def greatest_instant() -> Column:
    return F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz")


@named("minduration")
def least_duration() -> Column:
    return F.make_dt_interval(F.lit(-106_751_991))


@named("maxduration")
def greatest_duration() -> Column:
    return F.make_dt_interval(F.lit(106_751_991))


# Collections: vectors, sets and multisets are arrays; sets are distinct and sorted

FUNCTIONS |= {"size": F.size, "in": lambda x, c: F.array_contains(c, x), "concat_vectors": F.concat}


@named("create_vector", "makearray")
def vector(*xs: object) -> Column:
    return F.array(*map(literal, xs))


@named("create_set")
def set_(*xs: object) -> Column:
    return F.array_sort(F.array_distinct(F.array(*map(literal, xs))))


@named("create_multiset")
def multiset(*xs: object) -> Column:
    return F.array_sort(F.array(*map(literal, xs)))


@named("collection_contains")
def collection_contains(c: Column, x: object) -> Column:
    return F.array_contains(c, x)


@named("insert_element")
def insert_element(c: Column, x: object, as_set: bool = False) -> Column:
    out = F.array_append(c, x)
    return F.array_sort(F.array_distinct(out)) if as_set else out


@named("get")
def get(c: Column, index: object) -> Column:
    """Element by index from 0; undefined outside."""
    return F.get(c, index)


@named("put")
def put(c: Column, x: object, index: int) -> Column:
    return F.transform(c, lambda old, i: F.when(i == index, literal(x)).otherwise(old))


@named("deleteelem")
def delete_element(c: Column, x: object) -> Column:
    return F.array_remove(c, x)


@named("set_union")
def set_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


@named("set_intersection")
def set_intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


@named("difference", "sdiff")
def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


@named("minCommon")
def min_common(a: Column, b: Column) -> Column:
    return F.array_min(F.array_intersect(a, b))


@named("sortarray")
def sort_array(c: Column, key: Callable[[Column], Column] | None = None) -> Column:
    """By a key function; equal keys keep the order of elements by value."""
    if key is None:
        return F.array_sort(c)
    return F.transform(F.array_sort(F.transform(c, lambda x: F.struct(key(x).alias("k"), x.alias("x")))), lambda s: s["x"])


@named("tie")
def tie(c: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Reduce from the left; undefined for an empty array."""
    return F.when(F.size(c) > 0, F.reduce(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.get(c, F.lit(0)), f))


@named("cumulate")
def cumulate(c: Column, f: Callable[[Column, Column], Column]) -> Column:
    """All reductions of prefixes."""
    return F.transform(c, lambda _, i: tie(F.slice(c, F.lit(1), i + 1), f))


@named("loop")
def loop(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(c, f)


# Rectangles of any dimension: struct(lo array, hi array); undefined if a side is reversed


@named("rectangle2", "rectangle3", "rectangle4", "rectangle8")
def rectangle(*bounds: object) -> Column:
    """Low and high bound of each dimension in turn."""
    lo, hi = ([literal(x).cast("double") for x in part] for part in (bounds[::2], bounds[1::2]))
    good = reduce(lambda a, b: a & b, (x <= y for x, y in zip(lo, hi, strict=True)))
    return F.when(good, F.struct(F.array(*lo).alias("lo"), F.array(*hi).alias("hi")))


def _each(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


@named("rect_intersects", "bboxintersects")
def rect_intersects(a: Column, b: Column) -> Column:
    return F.forall(_each(a["lo"], b["hi"], lambda x, y: x <= y), lambda t: t) & F.forall(_each(b["lo"], a["hi"], lambda x, y: x <= y), lambda t: t)


@named("rect_inside")
def rect_inside(a: Column, b: Column) -> Column:
    return F.forall(_each(b["lo"], a["lo"], lambda x, y: x <= y), lambda t: t) & F.forall(_each(a["hi"], b["hi"], lambda x, y: x <= y), lambda t: t)


@named("rect_union")
def rect_union(a: Column, b: Column) -> Column:
    return F.struct(_each(a["lo"], b["lo"], lambda x, y: F.least(x, y)).alias("lo"), _each(a["hi"], b["hi"], lambda x, y: F.greatest(x, y)).alias("hi"))


@named("rect_intersection")
def rect_intersection(a: Column, b: Column) -> Column:
    """Undefined if they don't meet."""
    both = F.struct(_each(a["lo"], b["lo"], lambda x, y: F.greatest(x, y)).alias("lo"), _each(a["hi"], b["hi"], lambda x, y: F.least(x, y)).alias("hi"))
    return F.when(rect_intersects(a, b), both)


@named("rect_distance")
def rect_distance(a: Column, b: Column) -> Column:
    gaps = _each(_each(a["lo"], b["hi"], lambda x, y: x - y), _each(b["lo"], a["hi"], lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g))


@named("rect_size")
def rect_size(a: Column) -> Column:
    """Product of the sides."""
    return F.aggregate(_each(a["lo"], a["hi"], lambda x, y: y - x), F.lit(1.0), lambda s, d: s * d)


@named("perimeter")
def perimeter(a: Column) -> Column:
    return 2 * F.aggregate(_each(a["lo"], a["hi"], lambda x, y: y - x), F.lit(0.0), lambda s, d: s + d)


@named("minD")
def min_d(a: Column, dimension: int) -> Column:
    return a["lo"][dimension - 1]


@named("maxD")
def max_d(a: Column, dimension: int) -> Column:
    return a["hi"][dimension - 1]


@named("rectproject")
def rect_project(a: Column, x: int, y: int) -> Column:
    return F.struct(F.array(a["lo"][x - 1], a["lo"][y - 1]).alias("lo"), F.array(a["hi"][x - 1], a["hi"][y - 1]).alias("hi"))


@named("rect_translate")
def rect_translate(a: Column, *by: object) -> Column:
    shift = F.array(*(literal(b).cast("double") for b in by))
    return F.struct(_each(a["lo"], shift, lambda x, d: x + d).alias("lo"), _each(a["hi"], shift, lambda x, d: x + d).alias("hi"))


@named("extendGeo", "enlargeRect")
def enlarge(a: Column, by: object) -> Column:
    by = literal(by)
    return F.struct(F.transform(a["lo"], lambda x: x - by).alias("lo"), F.transform(a["hi"], lambda x: x + by).alias("hi"))


@named("scalerect")
def scale_rect(a: Column, *factors: object) -> Column:
    f = F.array(*(literal(x).cast("double") for x in factors))
    return F.struct(_each(a["lo"], f, lambda x, y: x * y).alias("lo"), _each(a["hi"], f, lambda x, y: x * y).alias("hi"))


@named("cellnumber")
def cell_number(a: Column, x0: float, y0: float, width: float, height: float, columns: int) -> Column:
    """Numbers (from 1, row by row) of the grid's cells that a 2-d rectangle meets, as an array; the outer cells catch what lies outside to the left and right."""
    cell = lambda v, start, size: F.floor((v - start) / size)
    clip = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(columns - 1)).cast("int")
    xs = F.sequence(clip(cell(a["lo"][0], x0, width)), clip(cell(a["hi"][0], x0, width)))
    ys = F.sequence(cell(a["lo"][1], y0, height).cast("int"), cell(a["hi"][1], y0, height).cast("int"))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: y * columns + x + 1)))


@named("gridcell2rect")
def grid_cell(number: Column, x0: float, y0: float, width: float, height: float, columns: int) -> Column:
    x, y = F.pmod(number - 1, F.lit(columns)), F.floor((number - 1) / columns)
    return F.struct(F.array(x0 + x * width, y0 + y * height).alias("lo"), F.array(x0 + (x + 1) * width, y0 + (y + 1) * height).alias("hi"))


@named("gridintersects")
def grid_intersects(a: Column, b: Column, cell: Column, x0: float, y0: float, width: float, height: float, columns: int) -> Column:
    """Whether two rectangles meet and the cell holds the least corner of their common part: true in one cell only for each pair."""
    corner = _each(a["lo"], b["lo"], lambda x, y: F.greatest(x, y))
    clip = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(columns - 1))
    own = F.floor((corner[1] - y0) / height) * columns + clip(F.floor((corner[0] - x0) / width)) + 1
    return rect_intersects(a, b) & (own == cell)


@named("cellnumberZ")
def z_order(x: Column, y: Column, bits: int = 16) -> Column:
    """Number of a cell on the z-curve, from the lowest bits of its coordinates."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        bit = lambda v, i=i: F.shiftright(v.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(bit(x), 2 * i)).bitwiseOR(F.shiftleft(bit(y), 2 * i + 1))
    return out


@named("toprightclass")
def top_right_class(a: Column, cell: Column) -> Column:
    """0 if a rectangle ends within the cell (another rectangle), 1 if it goes on to the right, 2 above, 3 both."""
    return F.when(a["hi"][0] >= cell["hi"][0], 1).otherwise(0) + F.when(a["hi"][1] >= cell["hi"][1], 2).otherwise(0)


@named("in_collection")
def in_collection(x: Column, c: Column) -> Column:
    return F.array_contains(c, x)


@named("partitionRect")
def partition_rect(a: Column, columns: int, rows: int) -> Column:
    """A 2-d rectangle cut into columns * rows equal ones, row by row from below, as an array."""
    side = lambda i, n: (a["hi"][i] - a["lo"][i]) / n

    def cell(n: Column) -> Column:
        x, y = n % columns, F.floor(n / columns)
        corner = lambda dx, dy: F.array(a["lo"][0] + (x + dx) * side(0, columns), a["lo"][1] + (y + dy) * side(1, rows))
        return F.struct(corner(0, 0).alias("lo"), corner(1, 1).alias("hi"))

    return F.transform(F.sequence(F.lit(0), F.lit(columns * rows - 1)), cell)


@named("toprightreport")
def top_right_report(classes: Column, others: Column) -> Column:
    """Whether a cell reports the pair of two rectangles of these classes (see top_right_class): neither direction is left by both."""
    return classes.bitwiseAND(others) == 0


@named("bbox_union")
def bounding_box(rects: Column) -> Column:
    """The box around an array of rectangles of the same dimension; undefined for an empty one."""
    rest = F.slice(rects, F.lit(2), F.greatest(F.size(rects) - 1, F.lit(0)))
    return F.when(F.size(rects) > 0, F.reduce(rest, F.get(rects, F.lit(0)), rect_union))


# Names that stand for different functions by the type of the first argument: array (collection) or struct (rectangle)

OVERLOADED: dict[str, dict[str, Callable[..., Column]]] = {
    "union": {"array": set_union, "struct": rect_union},
    "intersection": {"array": set_intersection, "struct": rect_intersection, "other": scalar_intersection},
    "insert": {"array": insert_element},
    "concat": {"array": F.concat, "other": F.concat},
    "contains": {"array": collection_contains, "struct": lambda a, b: rect_inside(b, a), "other": contains},
    "intersects": {"array": F.arrays_overlap, "struct": rect_intersects},
    "inside": {"struct": rect_inside, "array": lambda a, b: F.size(F.array_except(a, b)) == 0, "other": lambda x, c: F.array_contains(c, x)},
    "distance": {"struct": rect_distance},
    "translate": {"struct": rect_translate, "other": F.translate},
    "scale": {"struct": scale_rect},
    "bbox": {"struct": lambda a: a, "array": bounding_box},
    "size": {"array": F.size, "struct": rect_size},
    "components": {"array": F.explode},
}
FUNCTIONS |= {"collect_set": lambda x: F.array_sort(F.collect_set(x)), "collect_multiset": lambda x: F.array_sort(F.collect_list(x)),
    "collect_vector": lambda x: F.collect_list(x), "collect_intset": lambda x: F.array_sort(F.collect_set(x.cast("int"))), "feedIS": F.explode,
        "seqnext": F.monotonically_increasing_id, "binands": F.bit_and}
