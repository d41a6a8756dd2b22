import pytest

from tests.llm.helpers import rows
from vendora.llm import urlfilter as uf

RULES = [uf.Rule("block", "net", "/"), uf.Rule("allow", "example.net", "/en/"), uf.Rule("block", "example.com", "/de/"), uf.Rule("allow", "org", "/fr/")]
PAGES, OUT = "page_id long, url string, html string", "page_id long, bad boolean"


def run(spark, urls, outcomes=(), **kw):
    pages = spark.createDataFrame([(i, u, None) for i, u in (x if isinstance(x, tuple) else (k, x) for k, x in enumerate(urls))], PAGES)
    return uf.judge(pages.selectExpr("*", "1 as host", "2 as rule"), spark.createDataFrame(list(outcomes), OUT), RULES, **kw)


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q=1", "https://example.net/de/", "http://www.example.com/de/1#t", "http://example.com/de", "ftp://a.org/fr/",
            "http://notexample.net/en/", "http://xorg/fr/", "no scheme", None, "", "http://", "http://H?x://y/z", "http://a.net", "HTTP://ÄB.net/é?",
            "http://a.b.net/x://y", "http://example.net/EN/", "http://u:p@example.com:80/de/"]
    got = [tuple(r) for r in sorted(run(spark, urls).collect(), key=lambda r: r[0])]
    assert got == [
        (0, "a.example.net", "/en/x", "example.net/en/", "allow"), (1, "example.net", "/de/", "net/", "block"),
        (2, "www.example.com", "/de/1", "example.com/de/", "block"), (3, "example.com", "/de", None, "allow"),
        (4, "a.org", "/fr/", "org/fr/", "allow"), (5, "notexample.net", "/en/", "net/", "block"), (6, "xorg", "/fr/", None, "allow"),
        (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "", "", None, "allow"), (11, "h", "", None, "allow"),
        (12, "a.net", "", None, "allow"), (13, "Äb.net", "/é", "net/", "block"), (14, "a.b.net", "/x://y", "net/", "block"),
        (15, "example.net", "/EN/", "net/", "block"), (16, "u:p@example.com:80", "/de/", None, "allow")]


def weight(groups):
    v = [(n, y, m * (1 - m), m) for n, y, m in groups if n]
    scale = sum(x * (n - 1) for n, _, x, _ in v)
    rho = sum(n * (y / n - m) ** 2 - x for n, y, x, m in v) / scale if scale else 0.5
    return 1 / min(max(rho, 1e-3), 0.999) - 1


def test_reputation_matches_plain_arithmetic(spark):
    hosts = {"a.bad.co": (40, 38), "b.bad.co": (3, 3), "c.bad.co": (0, 0), "x.fine.co": (50, 1), "y.fine.co": (20, 0), "z.other.uk": (1, 1), "q.co.uk": (6, 0)}
    pages, outcomes = [], []
    for h, (n, y) in hosts.items():
        for k in range(n + 1):
            pages.append((len(pages), f"http://{h}/p{k}"))
            if k < n:
                outcomes.append((pages[-1][0], k < y))
    outcomes += [(pages[0][0], None), (None, True), (10**6, True)]
    dom = {h: ".".join(h.split(".")[-3 if h.endswith("co.uk") else -2:]) for h in hosts}
    suf = {h: "co.uk" if h.endswith("co.uk") else h.split(".")[-1] for h in hosts}

    def add(key):
        out = {}
        for h, (n, y) in hosts.items():
            a, b = out.get(key[h], (0, 0))
            out[key[h]] = (a + n, b + y)
        return out
    total = (sum(n for n, _ in hosts.values()), sum(y for _, y in hosts.values()))
    rate = (total[1] + 0.5) / (total[0] + 1)
    s = add(suf)
    ks = weight([(n, y, rate) for n, y in s.values()])
    sm = {k: (y + ks * rate) / (n + ks) for k, (n, y) in s.items()}
    d = add(dom)
    of = {dom[h]: suf[h] for h in hosts}
    kd = weight([(n, y, sm[of[k]]) for k, (n, y) in d.items()])
    dm = {k: (y + kd * sm[of[k]]) / (n + kd) for k, (n, y) in d.items()}
    kh = weight([(n, y, dm[dom[h]]) for h, (n, y) in hosts.items()])
    want = {}
    for h, (n, y) in hosts.items():
        mean = (y + kh * dm[dom[h]]) / (n + kh)
        want[h] = (mean, mean - 1.645 * (mean * (1 - mean) / (n + kh + 1)) ** 0.5)
    frame = spark.createDataFrame([(i, u.split("/")[2]) for i, u in pages], "page_id long, host string")
    got = {r.host: (r["mean"], r.bound) for r in uf.host_reputation(frame, spark.createDataFrame(outcomes, OUT)).collect()}
    assert set(got) == set(want)
    for h in hosts:
        assert got[h] == pytest.approx(want[h])
    judged = {r.host: r.verdict for r in run(spark, pages, outcomes).collect()}
    assert judged == {h: "block" if want[h][1] > 0.3 else "allow" for h in hosts}
    assert judged["a.bad.co"] == "block" and judged["x.fine.co"] == "allow"


def test_native_plan_repeats_and_empty(spark):
    df = run(spark, [(1, "http://a.co/x"), (1, "http://a.co/x"), (None, "http://a.co/y")], [(1, True), (1, False), (1, True)])
    assert len(rows(df)) == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert run(spark, []).count() == 0


def test_levels_of_addresses_ports_and_longer_suffixes(spark):
    hosts = ["1.2.3.4", "1.2.3.4:80", "9.2.3.4", "u@[::1]:8080", "a.b.co.uk", "co.uk", "uk", "", "x.y.pvt.k12.ma.us", "k12.ma.us", "1.2.3.4.com", "a.b.com.pl"]
    frame = spark.createDataFrame([(h, 1, 0) for h in hosts], "host string, n long, y long")
    listed = spark.createDataFrame([("co.uk",), ("k12.ma.us",), ("PVT.k12.ma.us",), (None,), ("co.uk",)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in uf._with_levels(frame, listed).collect()}
    assert got == {"1.2.3.4": ("1.2.3.4", ""), "1.2.3.4:80": ("1.2.3.4", ""), "9.2.3.4": ("9.2.3.4", ""), "u@[::1]:8080": ("[::1]", ""),
                   "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"), "": ("", ""),
                   "x.y.pvt.k12.ma.us": ("y.pvt.k12.ma.us", "pvt.k12.ma.us"), "k12.ma.us": ("k12.ma.us", "k12.ma.us"),
                   "1.2.3.4.com": ("4.com", "com"), "a.b.com.pl": ("com.pl", "pl")}


def test_given_suffixes_reach_the_verdict(spark):
    """Under co.zz the bad site says nothing of its neighbour, unless co.zz is taken for a domain."""
    urls = [(k, f"http://bad.co.zz/{k}") for k in range(30)] + [(100 + k, f"http://ok.co.yy/{k}") for k in range(30)] + [(200, "http://new.co.zz/")]
    outcomes = [(k, True) for k in range(30)] + [(100 + k, False) for k in range(30)]
    plain = {r.page_id: r.verdict for r in run(spark, urls, outcomes).collect()}
    listed = {r.page_id: r.verdict for r in run(spark, urls, outcomes, suffixes=spark.createDataFrame([("co.zz",), ("zz.co",)], "suffix string")).collect()}
    assert plain[0] == listed[0] == "block" and plain[100] == listed[100] == "allow"
    level = {}
    for name, s in (("plain", None), ("listed", spark.createDataFrame([("co.zz",)], "suffix string"))):
        frame = spark.createDataFrame([(i, u.split("/")[2]) for i, u in urls], "page_id long, host string")
        level[name] = {r.host: r["mean"] for r in uf.host_reputation(frame, spark.createDataFrame(outcomes, OUT), suffixes=s).collect()}
    assert level["plain"]["new.co.zz"] > level["listed"]["new.co.zz"]
