import math
import re
from collections import defaultdict

from tarn.llm import urls

URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :], re.S)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def general(path):
    path = re.sub(r"\b[0-9a-f]*[0-9][0-9a-f]{7,}\b", "{h}", path, flags=re.A)
    path = re.sub("/+", "/", re.sub("[0-9]+", "{n}", path))
    return re.sub("^/|/$", "", path)


def unlike(own, rest):
    """Two-sample z test of shares, (bad, labelled) each."""
    (x, n), (y, m) = own, rest
    if n < urls.LABELS or m < urls.LABELS or not 0 < x + y < n + m:
        return False
    p = (x + y) / (n + m)
    return abs(x / n - y / m) / math.sqrt(p * (1 - p) * (1 / n + 1 / m)) > urls.Z


def slow(pages, labels):
    """The tree of each host, node by node."""
    bad_of = {}
    for i, quality, toxic in (x for x in labels if x[0] is not None):
        bad_of[i] = max(bad_of.get(i, 0), int(quality == 0 or toxic == 1))
    hosts = defaultdict(list)
    for i, url in pages:
        host, path = split(url)
        hosts[host].append((general(path), bad_of.get(i)))
    total = [b for rows in hosts.values() for _, b in rows if b is not None]
    good = 1 - (sum(total) + 0.5) / (len(total) + 1)
    out = {}

    def counts(rows):
        known = [b for _, b in rows if b is not None]
        return sum(known), len(known)

    def less(a, b):
        return a[0] - b[0], a[1] - b[1]

    def grow(rows, template, level):
        """(template, rows) of the leaves below a node."""
        paths, whole = {g for g, _ in rows}, counts(rows)
        if all(len(g.split("/")) <= level for g in paths):
            return [(template, rows)]
        if len(paths) == 1:
            return [("/".join([template, *next(iter(paths)).split("/")[level:]]), rows)]
        if whole[1] < 2 * urls.LABELS:
            return [(f"{template}/**", rows)]
        kids = defaultdict(list)
        for g, b in rows:
            kids[(g.split("/")[level:] or [""])[0]].append((g, b))
        sides = defaultdict(list)
        for k, r in kids.items():
            own, rest = counts(r), less(whole, counts(r))
            sides["" if not unlike(own, rest) else "-" if own[0] * rest[1] > rest[0] * own[1] else "+"].append(k)
        branches = defaultdict(list)
        for side, members in sides.items():
            pool = counts([x for k in members for x in kids[k]])
            for k in members:
                alone = len(kids) == 1 if not side else len(members) == 1 or unlike(counts(kids[k]), less(pool, counts(kids[k])))
                branches[k if alone else f"*{side}"] += kids[k]
        return [leaf for name, r in branches.items() for leaf in grow(r, f"{template}/{name}", level + 1)]

    for host, rows in hosts.items():
        leaves = defaultdict(list)
        for template, r in grow(rows, "", 0):
            leaves[template] += r
        for template, r in leaves.items():
            bad, known = counts(r)
            for g, _ in r:
                out[host, g] = template, (known - bad + urls.STRENGTH * good) / (known + urls.STRENGTH)
    result = []
    for i, url in pages:
        host, path = split(url)
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        template, purity = out[host, general(path)]
        rule = max(fits)[1] if fits else None
        verdict = max(fits)[2] if fits else "block" if purity < urls.PURITY else "allow"
        result.append((i, host, path, rule, verdict, template, round(purity, 9)))
    return sorted(result, key=str)


def test_against_brute_force(spark, rng):
    pages = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://Example.NET/en/a?x=/b#c"), (6, "http://sub.example.net/EN/"),
        (7, "http://net"), (8, "http://net/"), (9, "x://a.example.com/de/1"), (10, "x://example.com/d"), (11, "http://wiki.org/fr/x"),
        (12, "http://h.io#f"), (13, "http://h.io?q=://z/1"), (14, "http://h.io//a///b/"), (15, "a\nb://h.io/l\nm"), (5, "http://same.id/x"),
        (None, "http://null.id/1"), (16, "http://H.io/" + "long/" * 3000), (17, "http://h.io/é/0123456789abcdef"),
    ]
    # A hot host with bad sections, many rare segments and deep paths.
    for i in range(100, 900):
        section = str(rng.choice(["news", "spam", "shop", f"u{rng.choice(list('abcdefghijklmnopqrstuvwxyz'))}{rng.choice(list('abcdefgh'))}x"]))
        pages.append((i, f"http://hot.io/{section}/{i}/{rng.choice(['a', 'b/c/d/e/f', ''])}"))
    labels = [(i, int("/spam/" not in (u or "")), int(rng.random() < 0.1)) for i, u in pages if i and rng.random() < 0.7]
    labels += [(100, 1, 0), (100, 0, 0), (None, 0, 1), (10**6, 0, 1), (9, None, None)]
    spread = spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, host string, template string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted((tuple(r) for r in urls.judge(spread, known).collect()), key=str)
    want = slow(pages, labels)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert all(abs(g[6] - w[6]) < 2e-9 for g, w in zip(got, want))
    assert {w[4] for w in want if w[1] == "hot.io" and "/spam" in w[2]} == {"block"}
    assert {w[4] for w in want if w[1] == "hot.io" and "/news" in w[2]} == {"allow"}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls.judge(pages, labels).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(one, labels).collect()] == ["allow"]


def verdicts(spark, pages, bad, labelled):
    """Verdicts by the start of the path, of pages (path, number), with shares of labelled and of bad pages."""
    rows, labels = [], []
    for path, n in pages:
        for k in range(n):
            i = len(rows)
            rows.append((i, f"http://h.io{path}/{k}x{'abcdefgh'[k % 8]}" if path.endswith("/") else f"http://h.io{path}"))
            if k < labelled(path, n):
                labels.append((i, int(k >= bad(path)), 0))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(tuple(r) for r in got) == slow(rows, labels) or [tuple(r)[:6] for r in sorted(got)] == [r[:6] for r in sorted(slow(rows, labels))]
    return {path: {r.verdict for r in got if r.path.startswith(path)} for path, _ in pages}


def test_unlabelled_siblings_bridge_nothing(spark):
    pages = [("/news", 300), ("/spam", 300), ("/misc", 50), ("/more", 50)]
    got = verdicts(spark, pages, lambda p: 300 if p == "/spam" else 0, lambda p, n: n if n == 300 else 0)
    assert got["/news"] == {"allow"} and got["/spam"] == {"block"}


def test_deep_and_rare_sections(spark):
    """A bad section in the eighth segment, and one that has one page in a hundred of a node with many children."""
    deep = "/a/b/c/d/e/f/g"
    pages = [(f"{deep}/good", 200), (f"{deep}/bad", 100), *((f"{deep}/other{'abcdefghijklmnopqrstuvwxyz'[i]}", 120) for i in range(26)), (f"{deep}/rare", 30)]
    got = verdicts(spark, pages, lambda p: 1000 if p.endswith(("bad", "rare")) else 2, lambda p, n: n)
    assert got[f"{deep}/good"] == {"allow"} and got[f"{deep}/bad"] == {"block"} and got[f"{deep}/rare"] == {"block"}
