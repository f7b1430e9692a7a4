from pyspark.sql import functions as F

from corpusql.functions import sqltext

# Ten stored baseline predictions (gold, predicted) and their exact-match verdicts.
# Stored records of one evaluation run.
GOLDEN = [
    ("SELECT count(*) FROM singer", "SELECT COUNT(*) FROM singer", True),
    ("SELECT count(*) FROM singer", "SELECT COUNT(*) FROM singer", True),
    ("SELECT name ,  country ,  age FROM singer ORDER BY age DESC",
     "SELECT Name, Country, Age\nFROM singer\nORDER BY Age DESC", False),
    ("SELECT name ,  country ,  age FROM singer ORDER BY age DESC",
     "SELECT Name, Country, Age\nFROM singer\nORDER BY Age DESC", False),
    ("SELECT avg(age) ,  min(age) ,  max(age) FROM singer WHERE country  =  'France'",
     "SELECT AVG(singer.Age) AS Average_Age, MIN(singer.Age) AS Minimum_Age, MAX(singer.Age) AS Maximum_Age\n"
     "FROM singer\nWHERE singer.Country = 'France'", False),
    ("SELECT avg(age) ,  min(age) ,  max(age) FROM singer WHERE country  =  'France'",
     "SELECT AVG(s.Age) AS Average_Age, MIN(s.Age) AS Minimum_Age, MAX(s.Age) AS Maximum_Age\n"
     "FROM singer s\nWHERE s.Country = 'France'", False),
    ("SELECT song_name ,  song_release_year FROM singer ORDER BY age LIMIT 1",
     "SELECT s.Name, s.Song_release_year\nFROM singer s\nJOIN singer_in_concert sic ON s.Singer_ID = sic.Singer_ID\n"
     "JOIN concert c ON c.concert_ID = sic.concert_ID\nJOIN stadium st ON st.Stadium_ID = c.Stadium_ID\n"
     "ORDER BY s.Age ASC\nLIMIT 1", False),
    ("SELECT song_name ,  song_release_year FROM singer ORDER BY age LIMIT 1",
     "SELECT Name, Song_release_year\nFROM singer\nWHERE Age = (SELECT MIN(Age) FROM singer)", False),
    ("SELECT DISTINCT country FROM singer WHERE age  >  20", "SELECT DISTINCT Country FROM singer WHERE Age > 20", True),
    ("SELECT DISTINCT country FROM singer WHERE age  >  20",
     "SELECT DISTINCT singer.Country\nFROM singer\nWHERE singer.Age > 20", False),
]


def _norm(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    return [r[0] for r in df.select(sqltext.normalize_sql("s")).collect()]


def test_golden_exact_match(spark):
    df = spark.createDataFrame([(g, p) for g, p, _ in GOLDEN], "g string, p string")
    got = [r[0] for r in df.select(sqltext.normalize_sql("g") == sqltext.normalize_sql("p")).collect()]
    assert got == [v for _, _, v in GOLDEN]
    assert sum(got) == 3


def test_normalize_edges(spark):
    out = _norm(spark, [
        "SELECT a -- note\nFROM t ;   ",
        "select A /* c */ from T",
        "SELECT 'It''s' FROM t",
        "SELECT 'ABC' FROM t",
        'SELECT "Col" FROM t',
        "SELECT 'open FROM t",
        "SELECT  1;;",
    ])
    assert out[0] == "select a from t"
    assert out[1] == "select a from t"
    assert out[2] == "select 'It''s' from t"
    assert out[3] == "select 'ABC' from t"          # literal case kept
    assert out[4] == 'select "Col" from t'          # quoted identifier kept
    assert out[5] == "select 'open from t"          # unterminated quote falls through
    assert out[6] == "select 1"


def test_normalize_idempotent(spark):
    texts = [g for g, _, _ in GOLDEN] + [p for _, p, _ in GOLDEN]
    once = _norm(spark, texts)
    assert _norm(spark, once) == once


def _extract(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "r string")
    return [(r[0], r[1]) for r in df.select(sqltext.extract_sql("r").alias("x")).select("x.sql", "x.strategy").collect()]


def test_extract_edges(spark):
    cases = [
        ("```sql\nSELECT 1;\n```", ("SELECT 1;", "fenced_block")),
        ("```\n```", ("", "fenced_block")),
        ("```sqlite\nSELECT 1\n```", ("ite\nSELECT 1", "fenced_block")),
        ("With this query you get it", ("With this query you get it", "leading_keyword")),
        ("SELECT a FROM t; SELECT b FROM u;", ("SELECT a FROM t", "leading_keyword")),
        ("select a\nfrom t\n\nExplanation", ("select a\nfrom t", "leading_keyword")),
        ("The answer:\n  SELECT x FROM y;  \nmore", ("SELECT x FROM y", "keyword_line")),
        ("no sql here", ("no sql here", "whole_text")),
        (" SELECT 1 ", ("SELECT 1", "leading_keyword")),
    ]
    assert _extract(spark, [c for c, _ in cases]) == [e for _, e in cases]


def test_feature_flags(spark):
    df = spark.createDataFrame([
        ("SELECT a FROM t JOIN u ON x = y WHERE b IN (SELECT c FROM v) GROUP BY a HAVING count(*) > 1 ORDER BY a",),
        ("SELECT a FROM t UNION SELECT b FROM u",),
        ("select name from t where name like '%x%'",),
    ], "q string")
    got = [r[0] for r in df.select(sqltext.feature_flags("q")).collect()]
    assert got[0] == ["JOINS", "SUBQUERY", "AGGREGATION", "GROUP BY", "HAVING", "ORDER BY", "NESTED"]
    assert got[1] == ["SUBQUERY", "SET OPS", "NESTED"]
    assert got[2] == ["LIKE"]
