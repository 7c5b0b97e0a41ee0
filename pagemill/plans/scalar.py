"""Queries of the scalar functions, over part and lineitem: one row per row, one column per case."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import calculator as calc
from pagemill.functions import formcalc as fc
from pagemill.functions import geometry as geo
from pagemill.functions import jsengine
from pagemill.functions import numbering as num
from pagemill.functions import script as js

QUERIES: dict = {}
ORACLES: dict = {}


def _case(query: str, table: str, key: str, **columns) -> None:
    """Registers alias=(Column, SQL) pairs over a table."""

    def run(spark: SparkSession, sf_dir: str):
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, *[(c() if callable(c) else c).alias(a) for a, (c, _) in columns.items()])

    QUERIES[query] = run
    ORACLES[query] = f"SELECT {key}, " + ", ".join(f'{s} AS "{a}"' for a, (_, s) in columns.items()) + f" FROM {table}"


def _part(query: str, **columns) -> None:
    _case(query, "part", "p_partkey", **columns)


name, size, price = (lambda: F.col("p_name")), (lambda: F.col("p_size").cast("double")), (lambda: F.col("p_retailprice"))
lit = F.lit
_part("fn_fc_concat", a=(lambda: fc.compile_script('Concat(n, "-", s, null) & b', _names())[0].column, "p_name || '-' || CAST(p_size AS VARCHAR) || p_brand"))


def _names() -> dict:
    return {"n": fc.Typed("str", F.col("p_name")), "b": fc.Typed("str", F.col("p_brand")), "s": fc.Typed("num", F.col("p_size").cast("double")), "p": fc.Typed("num", F.col("p_retailprice"))}


def _script(source: str) -> Column:
    return fc.compile_script(source, _names())[0].column


_part("fn_fc_left_right", l=(lambda: _script("Left(n, s / 4)"), "left(p_name, CAST(trunc(p_size / 4) AS INT))"), r=(lambda: _script("Right(n, s / 4)"), "right(p_name, CAST(trunc(p_size / 4) AS INT))"), all=(lambda: _script("Left(n)"), "p_name"), neg=(lambda: _script("Left(n, -1)"), "''"))
_part("fn_fc_len", n=(lambda: _script("Len(n)"), "CAST(length(p_name) AS DOUBLE)"), five=(lambda: _script('Len("hello")'), "5.0::DOUBLE"))
_part("fn_fc_substr", a=(lambda: _script("Substr(n, 2, s)"), "substr(p_name, 2, p_size)"), b=(lambda: _script("Substr(n, -3, 2)"), "substr(p_name, 1, 2)"), c=(lambda: _script("Substr(n, 2)"), "''"))
_part("fn_fc_case", u=(lambda: _script("Upper(n)"), "upper(p_name)"), l=(lambda: _script("Lower(b)"), "lower(p_brand)"))
_part("fn_fc_sum", a=(lambda: _script('Sum(s, 1, "x", 2.5)'), "p_size + 3.5::DOUBLE"))
_part("fn_fc_avg", a=(lambda: _script('Avg(s, "x", 3)'), "(p_size + 3.0::DOUBLE) / 3"))
_part("fn_fc_minmax", a=(lambda: _script('Min(s, 20, "x")'), "least(p_size, 20.0::DOUBLE)"), b=(lambda: _script("Max(s, 20)"), "greatest(p_size, 20.0::DOUBLE)"), c=(lambda: _script('Min("x")'), "0.0::DOUBLE"))
_part("fn_fc_round", a=(lambda: _script("Round(s / 4, 1)"), "round(p_size / 4.0::DOUBLE, 1)"), b=(lambda: _script("Round(-2.5)"), "-3.0::DOUBLE"), c=(lambda: _script("Round(3.14159, 2)"), "3.14::DOUBLE"))
_part("fn_fc_abs", a=(lambda: _script("Abs(s - 25)"), "abs(p_size - 25.0::DOUBLE)"))
_part("fn_fc_at", a=(lambda: _script('At(n, "e")'), "CAST(instr(p_name, 'e') AS DOUBLE)"), b=(lambda: _script('At("hello world", "world")'), "7.0::DOUBLE"))
_part("fn_fc_replace", a=(lambda: _script('Replace(n, "a", "<>")'), "replace(p_name, 'a', '<>')"), b=(lambda: _script('Replace(n, "a")'), "p_name"))
_part("fn_fc_stuff", a=(lambda: _script('Stuff(n, 3, 2, "**")'), "substr(p_name, 1, 2) || '**' || substr(p_name, 5)"), b=(lambda: _script('Stuff(n, 1000, 2, "!")'), "p_name || '!'"))
_part("fn_fc_space", a=(lambda: F.concat(lit("["), _script("Space(s)"), lit("]")), "'[' || repeat(' ', p_size) || ']'"), b=(lambda: _script("Space(-1)"), "''"))
_part("fn_fc_ops", a=(lambda: _script('s > "9" and not (n == "x")'), "p_size > 9"), b=(lambda: _script('b < "Brand#3"'), "p_brand < 'Brand#3'"), c=(lambda: _script("s / 0"), "'Infinity'::DOUBLE"), d=(lambda: _script("-s + 2 * 3 <> 4 or 0"), "-p_size + 6 <> 4"))
_part("fn_fc_control", a=(lambda: _script('if (p > 1500) then t = "high" elseif (p > 1200) then t = "mid" else t = "low" endif; t & "!"'), "CASE WHEN p_retailprice > 1500 THEN 'high' WHEN p_retailprice > 1200 THEN 'mid' ELSE 'low' END || '!'"))
_part("fn_fc_coerce", a=(lambda: _script('"1,234.5" + s'), "p_size + 1234.5::DOUBLE"), b=(lambda: _script('s & "|" & s / 2'), "CAST(p_size AS VARCHAR) || '|' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size / 2.0::DOUBLE AS VARCHAR) END"), c=(lambda: _script("not n"), "false"))
_part("fn_fc_exec", a=(lambda: _script('full = Upper(n) & " " & Upper(b); Len(full)'), "CAST(length(p_name || ' ' || p_brand) AS DOUBLE)"), b=(lambda: _script('Upper("ada") & " " & Upper("lovelace")'), "'ADA LOVELACE'"))


def _loops(spark: SparkSession, sf_dir: str):
    @F.pandas_udf("double")
    def total(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda n: float(fc.interpret("t = 0; for i = 1 upto s do t = t + i * i endfor; t", {"s": float(n)})[0] or 0))

    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", total("p_size").alias("squares"))


QUERIES["fn_fc_loops"] = _loops
ORACLES["fn_fc_loops"] = "SELECT p_partkey, CAST(p_size * (p_size + 1) * (2 * p_size + 1) / 6 AS DOUBLE) AS squares FROM part"

_part("fn_js_exec", a=(lambda: jsengine.script_udf("var t = ''; for (var i = 0; i < p_size % 4; i++) { t += p_name.charAt(i); } t.length > 0 ? t : 'none'", "p_name", "p_size"), "CASE WHEN p_size % 4 = 0 THEN 'none' ELSE substr(p_name, 1, p_size % 4) END"))
_part("fn_js_global", a=(lambda: js.to_int(price() / 7 - 100), "trunc(p_retailprice / 7 - 100)"), b=(lambda: js.is_nan(name()), "true"), c=(lambda: js.boolean_of(name()), "length(p_name) > 0"), d=(lambda: js.string_of(size()), "CAST(p_size AS VARCHAR)"))
_part("fn_js_math", a=(lambda: F.floor(price() / 7).cast("double"), "floor(p_retailprice / 7)"), b=(lambda: F.ceil(price() / 7).cast("double"), "ceil(p_retailprice / 7)"), c=(lambda: js.js_round(size() / 2), "round(p_size / 2.0::DOUBLE, 0)"), d=(lambda: js.js_sqrt(size()), "sqrt(p_size::DOUBLE)"), e=(lambda: js.trunc(-size() / 3) + 0.0, "trunc(-p_size / 3.0::DOUBLE) + 0.0"), f=(lambda: F.pow(size(), lit(2.0)), "pow(p_size::DOUBLE, 2)"))
_part("fn_js_string", a=(lambda: js.js_substr(name(), lit(-3), lit(2)), "substr(p_name, greatest(length(p_name) - 3, 0) + 1, 2)"), b=(lambda: js.js_substring(name(), lit(5), lit(2)), "substr(p_name, 3, 3)"), c=(lambda: js.char_at(name(), lit(1)), "substr(p_name, 2, 1)"), d=(lambda: js.index_of(name(), lit("e")), "CAST(instr(p_name, 'e') - 1 AS INT)"), e=(lambda: js.replace_first(name(), lit("a"), lit("(.)")), "CASE WHEN instr(p_name, 'a') > 0 THEN substr(p_name, 1, instr(p_name, 'a') - 1) || '(.)' || substr(p_name, instr(p_name, 'a') + 1) ELSE p_name END"), f=(lambda: js.split_first(name(), lit(" ")), "split_part(p_name, ' ', 1)"))

def _roman_digit(place: int) -> str:
    one, five, ten = {1: "IVX", 10: "XLC", 100: "CDM"}[place]
    x = f"((p_partkey // {place}) % 10)"
    return f"CASE {x} WHEN 9 THEN '{one}{ten}' WHEN 4 THEN '{one}{five}' ELSE CASE WHEN {x} >= 5 THEN '{five}' ELSE '' END || repeat('{one}', {x} % 5) END"


_ROMAN = f"repeat('M', p_partkey // 1000) || {_roman_digit(100)} || {_roman_digit(10)} || {_roman_digit(1)}"
_part("fn_roman", a=(lambda: num.roman(F.col("p_partkey")), f"CASE WHEN p_partkey <= 0 THEN CAST(p_partkey AS VARCHAR) ELSE {_ROMAN} END"), b=(lambda: num.roman(-F.col("p_partkey")), "CAST(-p_partkey AS VARCHAR)"))
_part("fn_alpha26", a=(lambda: num.letters(F.col("p_partkey")), "NULL"))
ORACLES["fn_alpha26"] = """
WITH RECURSIVE spelt(n, rest, s) AS (
  SELECT DISTINCT p_partkey, p_partkey, '' FROM part
  UNION ALL SELECT n, (rest - 1) // 26, chr(CAST(65 + (rest - 1) % 26 AS INT)) || s FROM spelt WHERE rest > 0)
SELECT p_partkey, CASE WHEN p_partkey <= 0 THEN CAST(p_partkey AS VARCHAR) ELSE s END AS a FROM part JOIN spelt ON n = p_partkey AND rest <= 0"""
_part("fn_tmpl", a=(lambda: num.template("Page {page} of {total} {{x}} {what} {filename} {number}", F.col("p_size"), lit(50), F.concat(lit("/d/"), name()), num.label(F.col("p_partkey"), "B-", width=6)), "'Page ' || p_size || ' of 50 {x} {what} ' || p_name || ' B-' || CASE WHEN p_partkey < 100000 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END"), b=(lambda: num.template("open {page", F.col("p_size"), lit(1)), "'open {page'"))
_case("fn_date", "orders", "o_orderkey", a=(lambda: num.template("{date} {time} {date:yyyy/MM}", lit(1), lit(1), stamp=F.col("o_orderdate")), "strftime(o_orderdate, '%Y-%m-%d %H:%M %Y/%m')"), b=(lambda: geo.parse_date(F.concat(lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), lit("+02'30'"))), "o_orderdate - INTERVAL 150 MINUTE"))
_part("fn_pdf_calc", a=(lambda: calc.calculator("{ dup 10 gt { 2 mul } { 3 add } ifelse }", [size()], [(0, 1000)])[0], "CASE WHEN p_size > 10 THEN p_size * 2.0::DOUBLE ELSE p_size + 3.0::DOUBLE END"), b=(lambda: calc.calculator("{ 0 div }", [size()], [(-1, 1)])[0], "0.0::DOUBLE"), c=(lambda: calc.calculator("{ 1 2 3 3 1 roll pop pop exch pop }", [size()], [(0, 100)])[0], "3.0::DOUBLE"), d=(lambda: calc.calculator("{ 7 mod neg 3 idiv }", [size()], [(-100, 100)])[0], "CAST(trunc(-(p_size % 7) / 3.0::DOUBLE) AS DOUBLE) + 0.0"), e=(lambda: calc.calculator("{ dup 4 and exch 2 bitshift or }", [size()], [(0, 1e6)])[0], "CAST((p_size & 4) | (p_size << 2) AS DOUBLE)"))
_part("fn_pdf_exponential", a=(lambda: calc.exponential(size() / 50, [0.0], [10.0], 2)[0], "pow(p_size / 50.0::DOUBLE, 2) * 10"))
_part("fn_pdf_stitch", a=(lambda: calc.stitched(size(), [lambda x: x * 2, lambda x: x + 100], [20.0], [(0, 1), (1, 0)], (0, 50)), "CASE WHEN p_size < 20 THEN (p_size * (1 / 20.0::DOUBLE)) * 2 ELSE (1 + (p_size - 20) * (-1 / 30.0::DOUBLE)) + 100 END"))
_part("fn_pdf_array", a=(lambda: F.array_join(F.array(*[x.cast("decimal(20,4)").cast("string") for x in calc.exponential(size(), [0.0, 1.0], [1.0, 3.0], 1)]), ","), "CAST(CAST(p_size AS DECIMAL(20,4)) AS VARCHAR) || ',' || CAST(CAST(1 + p_size * 2 AS DECIMAL(20,4)) AS VARCHAR)"))
_part("fn_pdf_sampled", a=(lambda: calc.sampled([size()], [3], [0.0, 10.0, 40.0], [(0, 50)]), "CASE WHEN p_size * (2 / 50.0::DOUBLE) < 1 THEN 0 * (1 - p_size * (2 / 50.0::DOUBLE)) + p_size * (2 / 50.0::DOUBLE) * 10 ELSE (1 - (p_size * (2 / 50.0::DOUBLE) - 1)) * 10 + (p_size * (2 / 50.0::DOUBLE) - 1) * 40 END"))
_part("fn_transform", a=(lambda: geo.apply_matrix(geo.compose(geo.matrix(2, 0, 0, 2, 1, 0), geo.matrix(0, 1, -1, 0, 0, 5)), size(), price())["x"], "0 * p_size + -2.0::DOUBLE * p_retailprice + 0"), b=(lambda: geo.invert(geo.matrix(2, 0, 0, 4, 6, 8))["e"], "-3.0::DOUBLE"))
_part("fn_fit", a=(lambda: geo.fit(lit(100.0), lit(50.0), size(), price())["scale"], "least(100.0::DOUBLE / p_size, 50.0::DOUBLE / p_retailprice)"))
_part("fn_color", a=(lambda: geo.cmyk_rgb(size() / 50, lit(0.0), lit(1.0), lit(0.5))["r"], "(1 - least(1.0::DOUBLE, p_size / 50.0::DOUBLE)) * 0.5"), b=(lambda: geo.hex_rgb(lit("#1aF"))["g"], "170"), c=(lambda: geo.argb(lit(255), F.col("p_size"), lit(0), lit(1)), "CAST(255 * 16777216::BIGINT + p_size * 65536 + 1 AS BIGINT)"))
_part("fn_measure", a=(lambda: geo.scaled(size() / 3, [(1.0, "ft", 0), (12.0, "in", 2)]), "CAST(CAST(floor(p_size / 3.0::DOUBLE) AS BIGINT) AS VARCHAR) || ' ft ' || printf('%.2f', (p_size / 3.0::DOUBLE - floor(p_size / 3.0::DOUBLE)) * 12) || ' in'"))
_part("fn_xfa_measure", a=(lambda: geo.points_of(F.concat(F.col("p_size").cast("string"), lit("in"))), "p_size * 72.0::DOUBLE"), b=(lambda: geo.points_of(lit("2.5em")), "30.0::DOUBLE"), c=(lambda: geo.points_of(name()), "CAST(NULL AS DOUBLE)"))
_part("fn_font_style", a=(lambda: geo.font_style(F.when(F.col("p_size") > 25, "ABCDEF+Noto-BoldItalic").otherwise("ArialMT"))["weight"], "CASE WHEN p_size > 25 THEN 700 ELSE 400 END"), b=(lambda: geo.font_style(F.when(F.col("p_size") > 25, "ABCDEF+Noto-BoldItalic").otherwise("ArialMT"))["family"], "CASE WHEN p_size > 25 THEN 'Noto' ELSE 'Arial' END"))
_part("flt_rect_contains", a=(lambda: geo.rect_contains(size(), price(), lit(10.0), lit(1000.0), lit(20.0), lit(500.0)), "p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 1000 AND 1500"), b=(lambda: geo.rect_intersect([size(), lit(0.0), lit(10.0), lit(10.0)], [lit(20.0), lit(5.0), lit(10.0), lit(10.0)])["width"], "CASE WHEN least(p_size + 10, 30) > greatest(p_size, 20) THEN CAST(least(p_size + 10, 30) - greatest(p_size, 20) AS DOUBLE) END"))
_part("flt_path_contains", a=(lambda: geo.path_contains(_square(), size(), lit(5.0)), "p_size >= 10 AND p_size < 30"), b=(lambda: geo.path_area(_square()), "200.0::DOUBLE"))


def _square() -> Column:
    return F.array(*[F.struct(lit(float(x)).alias("x"), lit(float(y)).alias("y")) for x, y in ((10, 0), (30, 0), (30, 10), (10, 10))])


