"""Every query with SQL gives the rows that DuckDB gives."""

import pytest
from conftest import DATA, rows_of

from vellum.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_identity_findings_vary(spark):
    got = {r["id"]: r["n"] for r in queries.msg_identity_findings(spark, str(DATA)).collect()}
    assert {"display-name-address", "display-name-brand", "replyto-freemail"} <= set(got)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["type", "value", "n", "first_seen", "weight"]


def test_plans_prune_and_push(spark):
    plan = queries.doc_emails(spark, str(DATA))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "source" not in plan.split("ReadSchema")[1]


def test_csv_of_all_urls(spark):
    from collections import Counter

    from vellum.plans import messages

    def dots(x):
        return x.replace(".", "[.]")

    risks = dict(zip(messages.URLS, ["", "brand-lookalike", "url-shortener", "ip-url", "credentials-url", "punycode", "direct-download", "direct-download", "risky-tld", "odd-port", "script-url", "script-url", "", "brand-lookalike", "", ""]))
    medium = {"url-shortener", "risky-tld", "odd-port"}
    want, seen = Counter(), {}
    for r in messages.relation(spark, str(DATA), "urls").collect():
        seen[r["message_id"], r["value"]] = seen.get((r["message_id"], r["value"]), False) or r["is_mismatch"]
    for (k, url), mismatch in seen.items():
        scheme, _, rest = url.partition("://")
        host, slash, path = rest.partition("/")
        shown = url
        if rest:
            path = path.replace("archive.zip", "archive[.]zip").replace("evil.example", "evil[.]example")
            shown = scheme.replace("http", "hxxp") + "[://]" + dots(host.replace("@", "[@]")) + slash + path
        names = [x for x in (risks[url], "mismatch" if mismatch and rest else "") if x]
        level = "" if not names else "medium" if names[0] in medium and len(names) == 1 or names == ["direct-download"] and "zip" in url else "high"
        value = f'"{shown}"' if "," in shown else shown
        want[k, f"url,{value},body,{'; '.join(names)},{level},,,"] += 1
        if "safelinks" in url:
            want[k, f"url,hxxps[://]evil[.]example/a,unwrapped,,,{shown},,"] += 1
    assert {u for _, u in seen} == set(messages.URLS)
    assert Counter((r["message_id"], r["line"]) for r in queries.msg_ioc_csv_all(spark, str(DATA)).collect()) == want
