"""Event XPath and query lists against plain Python predicates."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.plans import xpath
from logloom.plans.xpath_reader import AllOf, AnyOf, Not, parse
from logloom.schema import conform

NOW = datetime(2026, 2, 20, 12)


@pytest.fixture(scope="module")
def rows(spark):
    made = []
    for i in range(60):
        data = {"LogonType": str(i % 4), "User": f"u{i % 7}", "Empty": ""} if i % 5 else None
        made.append((i, i % 6 or None, i % 5, f"Prov{i % 3}" if i % 11 else None, "Security" if i % 2 else "System", datetime(2026, 2, 1 + i % 28), i * 3, "S-1-5-18" if i % 4 else None, data, 1 << (i % 5)))
    schema = "record_id bigint, id int, level int, provider_name string, log_name string, time_created timestamp_ntz, process_id int, user_id string, data map<string,string>, keywords bigint"
    return conform(spark.createDataFrame(made, schema)).cache(), made


def check(rows, text, wanted):
    frame, made = rows
    assert sorted(r.record_id for r in frame.where(xpath.xpath_column(text, NOW)).select("record_id").collect()) == [r[0] for r in made if wanted(*r)], text


CASES = {
    "*[System[EventID=3]]": lambda i, d, lv, p, g, t, pid, u, data, k: d == 3,
    "Event[System[EventID != 3]]": lambda i, d, lv, p, g, t, pid, u, data, k: d is not None and d != 3,
    "*[System[not(EventID=3)]]": lambda i, d, lv, p, g, t, pid, u, data, k: d != 3,
    "*[not(System[EventID=3 or Level=2])]": lambda i, d, lv, p, g, t, pid, u, data, k: not (d == 3 or lv == 2),
    "not(*[System[(EventID=3) and not(Level=2)]])": lambda i, d, lv, p, g, t, pid, u, data, k: not (d == 3 and lv != 2),
    "*[System[Provider[@Name='prov1' or @Name='Prov2'] and (Level &gt;= 1 and Level &lt; 4)]]": lambda i, d, lv, p, g, t, pid, u, data, k: p in ("Prov1", "Prov2") and 1 <= lv < 4,
    "*/System/Provider/@Name='Prov0'": lambda i, d, lv, p, g, t, pid, u, data, k: p == "Prov0",
    "*[System[Execution[@ProcessID=30] or Security[@UserID='S-1-5-18' and not(.)]]]": None,
    "*[System/Execution/@ProcessID=30]": lambda i, d, lv, p, g, t, pid, u, data, k: pid == 30,
    "*[System[Security/@UserID]]": lambda i, d, lv, p, g, t, pid, u, data, k: u is not None,
    "*[System[not(Security/@UserID)]]": lambda i, d, lv, p, g, t, pid, u, data, k: u is None,
    "*[System[Channel='Security' and band(Keywords, 0x6)]]": lambda i, d, lv, p, g, t, pid, u, data, k: g == "Security" and k & 6,
    "*[System[not(band(Keywords,6))]]": lambda i, d, lv, p, g, t, pid, u, data, k: not k & 6,
    "*[System[TimeCreated[@SystemTime &gt;= '2026-02-10T01:00:00.0000000+01:00' and @SystemTime &lt; '2026-02-12T00:00:00Z']]]": lambda i, d, lv, p, g, t, pid, u, data, k: datetime(2026, 2, 10) <= t < datetime(2026, 2, 12),
    "*[System[TimeCreated[timediff(@SystemTime) &lt;= 172800000]]]": lambda i, d, lv, p, g, t, pid, u, data, k: t >= datetime(2026, 2, 18, 12),
    "*[EventData[Data[@Name='logontype']='2']]": lambda i, d, lv, p, g, t, pid, u, data, k: bool(data) and data["LogonType"] == "2",
    "*[EventData[Data[@Name='LogonType']!='2']]": lambda i, d, lv, p, g, t, pid, u, data, k: bool(data) and data["LogonType"] != "2",
    "*[EventData[not(Data[@Name='LogonType']='2')]]": lambda i, d, lv, p, g, t, pid, u, data, k: not data or data["LogonType"] != "2",
    "*[EventData[Data[@Name='Empty'] and not(Data[@Name='Gone'])]]": lambda i, d, lv, p, g, t, pid, u, data, k: bool(data),
    "*[EventData[Data='u3']]": lambda i, d, lv, p, g, t, pid, u, data, k: bool(data) and "u3" in data.values(),
    "*[not(EventData[Data='u3'])]": lambda i, d, lv, p, g, t, pid, u, data, k: not data or "u3" not in data.values(),
    "*[EventData[Data[(@Name='User' or @Name='Other') and .='u3']]]": lambda i, d, lv, p, g, t, pid, u, data, k: bool(data) and data["User"] == "u3",
    "*[EventData[Data[@Name='User' and not(.='u3')]]]": lambda i, d, lv, p, g, t, pid, u, data, k: bool(data) and data["User"] != "u3",
    "Event/EventData/Data[@Name='User']='u&amp;3'": lambda *_: False,
    "*[UserData[EventXML[User='u1']]]": lambda i, d, lv, p, g, t, pid, u, data, k: bool(data) and data["User"] == "u1",
    "*[UserData/*/LogonType='1' or UserData/Holder/User]": lambda i, d, lv, p, g, t, pid, u, data, k: bool(data),
    "*[System]": lambda *_: True,
    " * ": lambda *_: True,
}


@pytest.mark.parametrize("text", [t for t, w in CASES.items() if w])
def test_xpath(rows, text):
    check(rows, text, CASES[text])


def test_tree():
    tree = parse("*[System[(EventID=1 or EventID=2) and not(Level=3)]]")
    inner = tree.steps[0][1][0].steps[0][1][0]
    assert isinstance(inner, AllOf) and isinstance(inner.parts[0], AnyOf) and isinstance(inner.parts[1], Not)


@pytest.mark.parametrize("text", ["*[System[Nonsense=1]]", "*[System[EventID=]]", "*[System[EventID=1]", "*[System[(EventID=1]]", "EventID=1]", "*[Other[A=1]]", "*[System[timediff(@SystemTime) < 5]]", "*[EventData[Data[@Id='1']='x']]", "*[UserData[A[B[C='x']]]]", "*[System[Level='high']]", "*[System[position() < 3]]", "<QueryList/>", "<QueryList><Query>", "<Other/>", '<!DOCTYPE x><QueryList><Query><Select>*</Select></Query></QueryList>', "<QueryList><Query><Suppress>*</Suppress></Query></QueryList>"])
def test_refused(text):
    with pytest.raises(ValueError):
        xpath.xpath_column(text)


def test_query_lists(rows):
    text = """<QueryList>
      <Query Id="0" Path="Security"><Select>*[System[Level=1 or Level=2]]</Select><Select Path="System">*[System[EventID=3]]</Select>
        <Suppress>*[EventData[Data[@Name='User']='u2']]</Suppress><Suppress Path="System">*[System[Level=4]]</Suppress></Query>
      <Query Id="1" Path="file://C:\\x.evtx"><Select>*[System[EventRecordID=44]]</Select></Query>
    </QueryList>"""

    def wanted(i, d, lv, p, g, t, pid, u, data, k):
        taken = g == "Security" and lv in (1, 2) or g == "System" and d == 3
        back = g == "Security" and bool(data) and data["User"] == "u2" or g == "System" and lv == 4
        return taken and not back or i == 44

    check(rows, text, wanted)
    check(rows, '<QueryList><Query Path="System"><Select>*</Select><Suppress>*[System[Level &lt;= 3]]</Suppress></Query></QueryList>', lambda i, d, lv, p, g, *_: g == "System" and lv > 3)


def test_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(5).select(F.col("id").alias("record_id"), F.col("id").cast("int").alias("level"), F.lit(4625).alias("id"), F.lit("Security").alias("log_name")).write.parquet(f"file://{tmp_path}/t")
    text = '<QueryList><Query Path="Security"><Select>*[System[EventID=4625]]</Select><Suppress>*[System[Level=4]]</Suppress></Query></QueryList>'
    plan = spark.read.parquet(f"file://{tmp_path}/t").where(xpath.xpath_column(text))
    shown = plan._jdf.queryExecution().executedPlan().toString()
    pushed = shown[shown.index("PushedFilters") :]
    assert plan.count() == 4 and "EqualTo(id,4625)" in pushed and "EqualTo(log_name,Security)" in pushed and "Or(Or(Not(Eq" in pushed
