"""Statements in the embedded engine's dialect, each answered by Spark as DuckDB answers it."""

import decimal

import duckdb
import pytest

from spanfold import sql

STATEMENTS = [
    "select cast(3.5 as integer), cast(2.5 as integer), cast(-2.7 as integer), cast('3.7' as integer), try_cast('abc' as integer), cast(true as integer), cast(null as integer)",
    'select x, cast(d as integer) c, d::bigint e, (d+0.25)::int f from t',
    "select 9.99::integer, '  5 '::integer, '1e3'::integer",
    'select x/0, 0/x, -x/0.0, x/3, x/d from t',
    'select count(*) / sum(d) from t where x > 2',
    "select concat('a', null, 'b'), concat(x, s) from t",
    "select extract(dow from ts), dayofweek(ts), weekday(ts), isodow(ts), extract(isodow from ts), dayname(ts), monthname(ts), extract(second from ts), date_part('millisecond', ts), extract(week from ts), extract(doy from ts), extract(year from ts), date_part('quarter', ts), second(ts) from t",
    'select log(100), log(2, 8), ln(1), 5 ^ 2, 2 ** 3, 2^3^2, -2^2, x^2 + 1 from t',
    "select substr('abc', 0, 2), substr('abc', 1, 2), substr('abc', -2, 2), substring('abc', 2), substr('hello', x::int, 2) from t where x < 5",
    "select string_split('a.b.c', '.'), string_split('abc', ''), split_part('a.b', '.', 2), str_split('a|b', '|')",
    "select ltrim('xxa', 'x'), rtrim('axx','x'), trim('xax','x'), trim('  a ')",
    'select round(skewness(d*d),6), round(kurtosis(d*d),6), round(kurtosis_pop(d*d), 6) from t',
    'select g, round(kurtosis(d*d) filter (where x > 1),6), round(product(x+1),0), round(geomean(x+1),6), round(sem(x),6) from t group by g',
    "select strpos('hello','l'), epoch_ms(ts), unicode('é'), suffix('abc','bc'), prefix('abc','ab'), format('{} x {}', 1, 'b') from t",
    "select date_diff('day', u, ts), date_diff('month', u, ts), date_diff('hour', u, ts), date_diff('minute', u, ts), date_diff('year', u, ts), date_diff('quarter', u, ts), date_diff('second', u, ts), datediff('day', u, ts) from t",
    "select date_sub('month', u, ts), date_sub('day', u, ts), date_sub('hour', u, ts) from t",
    "select sha256('a'), md5('a')",
    'select range(3), generate_series(1,3), range(2,5), range(0)',
    'select * from range(5)',
    'select * from generate_series(1,3) g(v)',
    'select sum(range) from range(1, 10, 2)',
    'select unnest([1,2,3]) as v',
    'select * from unnest([1,2]) u(v)',
    'select [1,2,3][2], [1,2,3][0], [1,2,3][-1], [1,2,3][2:], [1,2,3][1:2], [1,2,3][:-2], [x, 2][1] from t',
    'select g, list(x order by x desc) as l, list(s order by x) as m, array_agg(x order by d) as a from t group by g',
    'select first(x order by d desc), last(x order by d), first(s order by x) from t',
    'select \'{"a":{"b":1,"c":"t"}}\' -> \'a\' ->> \'b\', \'{"a":"t"}\' -> \'a\', json_extract(\'{"a":[1,2]}\', \'$.a\'), \'[5,6]\' ->> 1',
    "select 'abc' similar to 'a.c', 'abc' ~ 'b', 'abc' glob 'a*', regexp_full_match('abc','a.c')",
    "select left('abcd',-1), right('abcd',-1), trunc(-2.7::double), xor(5,1), bit_count(5), chr(65), ascii('A')",
    'select distinct on (g) g, x from t order by g, x desc',
    'select x, g from t qualify row_number() over (partition by g order by x desc) = 1',
    'select x from t where x < 3 union by name select g as y, x from t where x > 18',
    'select x as a, s from t where x < 3 union all by name select s, g as b from t where x > 17 order by a',
    'pivot t on g using count(*) group by s',
    'pivot (select g, x % 2 as p, d from t) on g in (0, 1) using sum(d) group by p',
    'pivot (select g, x % 2 as p, d from t) on g using sum(d)',
    'pivot (select g, x % 2 as p, d from t) on p using sum(d) as total, count(*) as n group by g order by g',
    'unpivot (select x, d as a, d * 2 as b from t) on a, b into name n value v',
    'select * replace (x * 2 as x) from t',
    'select count(*) from t using sample 100%',
    'select count(*) from (select * from t using sample 5 rows)',
    'select count(*) from t using sample reservoir(7 rows)',
    'select a.x, b.ts as tb, b.d from t a asof join t b on a.g = b.g and a.ts >= b.u',
    'select a.x, b.u from t a asof left join (select g, u, d from t where x > 5) b on a.g = b.g and a.ts >= b.u where a.x > 2 order by a.x',
    'select coalesce(a.g, b.g) as k, count(distinct a.x) as n, count(distinct b.s) as m from t a full outer join (select * from t where g < 2) b on a.g = b.g group by coalesce(a.g, b.g) order by n + m desc',
    'select a.g, count(distinct a.x) as n, count(distinct b.s) as m from t a left join t b on a.g = b.g group by a.g having count(distinct b.s) > 2',
    'from t where x < 3',
    'from t select x limit 3',
    "select strftime(ts, '%a %b %-d %I %p'), strptime('2024-01-02 03:04', '%Y-%m-%d %H:%M') from t",
    "select cast([1,2] as varchar[]), ['1']::integer[]",
    'select case when x > 2 then x else 0 end::integer from t',
    "select regexp_replace('abcabc', 'b(c)', 'X\\1'), regexp_replace('abcabc', 'b', 'X', 'g')",
    'select natural1.x from t natural1 natural join (select x, 1 as one from t where x < 2) q',
    'select nullif(x, 3), greatest(1, null), x // 3, x % 3 from t',
    "select struct_pack(a := 1).a, struct_extract({'k': 5}, 'k'), list_value(1,2), map_keys(map {'a': 1}), cardinality(map {'a': 1})",
    'select json_array_length(\'[1,2]\'), json_valid(\'{\'), json_keys(\'{"a":1}\')',
    'select approx_count_distinct(g) = 3 from t',
    'select count(*) filter (where g = 1) * 100.0 / count(*) from t',
    "select last_day(date '2024-02-03'), make_timestamp(2024,1,2,3,4,5.5), make_date(2024,2,3)",
    'select epoch(ts), to_days(3), ts + to_hours(2) from t',
    'select x from t order by s, x limit 5',
    "select listagg(s, ',' order by x) from t",
    'select quantile_disc(d, 0.5), mode(g) from t group by g',
    "select {'a': 1, 'b': 'x'}.b as s, map {'a': 1, 'b': 2}['a'] as m, {'a': {'b': 2}}.a.b as z",
    'select list_transform([1,2], lambda v: v * 2), list_distinct([1,1,null]), len([1,2]), list_sort([3,null,1]), list_avg([1,2])',
]


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return sorted(((plain(k), plain(x)) for k, x in v.items()), key=repr)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    con = duckdb.connect()
    con.execute(
        "create table t as select x, x % 3 as g, case when x % 4 = 0 then null else 'n' || x end as s, x / 2.0::double as d,"
        " timestamp '2024-01-30 10:00:00.5' + interval (x * 37) hour as ts, timestamp '2024-01-01 00:00:00' + interval (x) day as u from range(20) r(x)"
    )
    path = tmp_path_factory.mktemp("t") / "t.parquet"
    con.execute(f"copy t to '{path}'")
    spark.read.parquet(str(path)).createOrReplaceTempView("t")
    yield con
    spark.catalog.dropTempView("t")


@pytest.mark.parametrize("text", STATEMENTS)
def test_statement(spark, both, text):
    want = sorted(repr(plain(r)) for r in both.execute(text).fetchall())
    assert sorted(repr(plain(tuple(r))) for r in sql.query(spark, text).collect()) == want


@pytest.mark.parametrize(
    "text",
    [
        "select hash('a')", "select * from a positional join b", "update t set x = 1", "select date_diff('week', u, ts) from t", "select list(x order by g desc, x) from t",
        "select strftime(ts, '%Q') from t", "select a.x from t a asof join t b on a.g = b.g and a.ts > b.u", "select regexp_replace(s, 'a', s) from t", "select count(*) from t a join t b using (x) using sample 5%",
    ],
)
def test_what_has_no_form_raises(spark, both, text):
    with pytest.raises(sql.Unsupported):
        sql.query(spark, text)


def test_samples(spark, both):
    n = lambda text: sql.query(spark, text).count()
    assert n("select x from t using sample 7 rows") == 7 and n("select x from t using sample 0%") == 0
    assert n("select x from t using sample 100 percent (bernoulli, 3)") == 20
    a, b = ([r.x for r in sql.query(spark, "select x from t using sample 50% (bernoulli) repeatable (5)").collect()] for _ in range(2))
    assert a == b and 0 < len(a) < 20


def test_counts_before_the_join(spark, both):
    text = "select a.g, count(distinct a.x) as n, count(distinct b.s) as m from t a left join t b on a.g = b.g group by a.g"
    plan = sql.query(spark, text)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("count(distinct") if "count(distinct" in plan else "Join" in plan
    # Other sums, or a join that is no plain equality of keys, stay as they are.
    for other in (text.replace("count(distinct b.s)", "count(b.s)"), text.replace("a.g = b.g", "a.g = b.g and a.x > b.x"), text.replace("left join", "full join")):
        want = sorted(map(repr, both.execute(other).fetchall()))
        assert sorted(repr(tuple(r)) for r in sql.query(spark, other).collect()) == want
        assert "__d0" not in sql.translate(other)


def test_settings_and_files(spark, tmp_path):
    assert sql.execute(spark, "SELECT value FROM duckdb_settings() WHERE name = 'spark.sql.session.timeZone'")["rows"] == [["UTC"]]
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,y\n")
    assert sql.execute(spark, f"SELECT a + 1, b FROM read_csv('{tmp_path}/a.csv') ORDER BY a")["rows"] == [[2, "x"], [3, "y"]]
    sql.execute(spark, f"COPY (SELECT 7 AS k) TO '{tmp_path}/p.parquet' (FORMAT parquet)")
    assert sql.execute(spark, f"FROM '{tmp_path}/p.parquet'")["rows"] == [[7]]
