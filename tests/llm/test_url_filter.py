import math
import random

from threadloom.llm import url_filter as U


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:end]


URLS = [
    "http://A.Example.NET/en/x", "https://example.net", "https://example.net/en", "http://bad.org/fr/", "http://bad.org/x?y#z", "x", None, "", "http://", "://h/p",
    "http://a.b://c/d", "http://notnet/", "http://xexample.com/de/1", "http://www.example.com/de/1", "http://É.com/ä", "ftp://u:p@h.net:80/x", "http://h.net?q=/en/", "http://q.com\n/x",
]


def _reputation(rows, outcomes):
    host, bad = {}, {}
    for i, u in rows:
        h = _parts(u)[0]
        host.setdefault(h, [0, 0])
        for o in outcomes.get(i, []):
            host[h][0] += 1
            host[h][1] += o
    total = [sum(v[k] for v in host.values()) for k in (0, 1)]
    root = (total[1] + 1) / (total[0] + 2)

    def strength(groups):
        k, n = sum(n > 0 for n, _, _ in groups), sum(n for n, _, _ in groups)
        if n <= k:
            return U.STRENGTH
        s = sum(n * (b / n - m) ** 2 / (m * (1 - m)) for n, b, m in groups if n)
        return 1 / round(max(U.RHO[0], min(U.RHO[1], (s - k) / (n - k))), 6) - 1

    def level(name, parent):
        out = {}
        for h, (n, b) in host.items():
            x = out.setdefault(name(h), [0, 0])
            x[0] += n
            x[1] += b
        own = strength([(n, b, parent(k)) for k, (n, b) in out.items()])
        return {k: (b + own * parent(k)) / (n + own) for k, (n, b) in out.items()}

    suffix = level(lambda h: h.split(".")[-1], lambda k: root)
    domain = level(lambda h: ".".join(h.split(".")[-2:]), lambda k: suffix[k.split(".")[-1]])
    mean = {h: domain[".".join(h.split(".")[-2:])] for h in host}
    own = strength([(n, b, mean[h]) for h, (n, b) in host.items()])
    for h, (n, b) in host.items():
        a, c = b + own * mean[h], n - b + own * (1 - mean[h])
        bad[h] = (a / (a + c), a / (a + c) - U.Z * math.sqrt(a * c / ((a + c) ** 2 * (a + c + 1))))
    return bad


def test_against_plain_python(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 6)] + [(1000 + i, f"http://spam.evil.info/{i}") for i in range(60)]
    outcomes = {i: [1] if i >= 1000 else [i % 2] for i, _ in rows if i % 3}
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, o) for i, os in outcomes.items() for o in os], "page_id bigint, bad int")
    got = {r.page_id: r for r in U.judge_urls(pages, labels).collect()}
    want = _reputation(rows, outcomes)
    assert len(got) == len(rows)
    for i, u in rows:
        h, p = _parts(u)
        fits = [(rh + rp, v) for v, rh, rp in U.RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, rule), u
        assert abs(got[i].bad_rate - want[h][0]) < 1e-8 and abs(got[i].bad_lower - want[h][1]) < 1e-8
        assert got[i].verdict == (verdict or ("block" if want[h][1] > U.LIMIT else "allow"))
    assert {got[i].verdict for i in got if i >= 1000} == {"block"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id bigint, bad int")
    assert U.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), none).count() == 0
    r = U.judge_urls(spark.createDataFrame([(1, "http://a.com/x", 5), (None, None, 6)], "page_id bigint, url string, host int"), none).collect()
    assert {x.verdict for x in r} == {"allow"} and len(r) == 2


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.bco.uk": ("bco.uk", "uk"), "w.example.org": ("example.org", "org"), "localhost": ("localhost", "localhost"), "": ("", "")}
    got = U._with_levels(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()
    assert {r.host: (r.domain, r.suffix) for r in got} == hosts


def test_strength_is_fitted(spark):
    """Groups drawn around 0.3 with a strength give about that strength back; equal rates the largest, opposite ones the smallest."""
    draw = random.Random(4)

    def fit(rows):
        return U.fitted_strength(spark.createDataFrame(rows, "n bigint, bad bigint, m double")).first().strength

    for true in (3.0, 12.0, 60.0):
        rows = []
        for _ in range(4000):
            p, n = draw.betavariate(0.3 * true, 0.7 * true), draw.randrange(0, 40)
            rows.append((n, sum(draw.random() < p for _ in range(n)), 0.3))
        assert 0.8 * true < fit(rows) < 1.25 * true
    assert abs(fit([(100, 30, 0.3)] * 50) - 999) < 1e-6 and abs(fit([(100, 100 * (k % 2), 0.5) for k in range(50)]) - 1) < 1e-6
    assert fit([(1, 1, 0.5), (0, 0, 0.5), (1, 0, 0.5)]) == U.STRENGTH == fit([])


def test_suffix_table(spark):
    table = spark.createDataFrame([("City.Example",), ("co.uk",), (None,), ("co.uk",)], "suffix string")
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.town.city.example": ("town.city.example", "city.example"), "a.com.au": ("com.au", "au"), "": ("", "")}
    got = U._with_levels(spark.createDataFrame([(h,) for h in hosts], "host string"), table).collect()
    assert {r.host: (r.domain, r.suffix) for r in got} == hosts
    pages = spark.createDataFrame([(k, f"http://bad{k}.town.city.example/") for k in range(40)] + [(99, "http://fine.city.example/")], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(k, 1) for k in range(40)] + [(99, 0)], "page_id bigint, bad int")
    verdict = {r.page_id: r.verdict for r in U.judge_urls(pages, outcomes, suffixes=table).collect()}
    assert verdict[3] == "block" and verdict[99] == "allow"
