"""The URL filter against rules found by counting every subset of tokens."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm import url_filter as uf

SF = "/root/testdata/sf0.1"


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = rest[:end], rest[end:]
    end = min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def brute_rule(rules, url):
    host, path = brute_split(url)
    fit = []
    for r in rules:
        h, _, p = r.text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append(((len(r.text), len(h), r.block), r))
    return max(fit, key=lambda x: x[0])[1] if fit else None


def brute_mine(labelled, support, confidence):
    """{(tokens, label): (confidence, hits)} of the rules that stay."""
    n, share = len(labelled), sum(b for _, b in labelled) / len(labelled)
    sets = [(uf.tokens_of(u), b) for u, b in labelled]
    count, bad = Counter(), Counter()
    for tokens, b in sets:
        count.update(tokens)
        bad.update(tokens if b else ())
    telling = {t: abs(bad[t] / c - share) * c**0.5 for t, c in count.items() if c >= support * n}
    whole, with_label = Counter(), Counter()
    for tokens, b in sets:
        own = sorted(sorted((t for t in tokens if t in telling), key=lambda t: (-telling[t], t))[: uf.MAX_ITEMS])
        for k in range(1, len(own) + 1):
            for x in itertools.combinations(own, k):
                whole[x] += 1
                with_label[x, uf.BLOCK if b else uf.ALLOW] += 1
    # FP-growth counts a set as frequent from ceil(support * n) transactions.
    rules = {k: (h / whole[k[0]], h) for k, h in with_label.items() if h >= support * n and h / whole[k[0]] >= confidence}
    return {
        (x, lab): v
        for (x, lab), v in rules.items()
        if not any((y, lab) in rules and rules[y, lab][0] >= v[0] for k in range(1, len(x)) for y in itertools.combinations(x, k))
    }


def as_dict(mined):
    return {(tuple(r.tokens), r.label): (r.confidence, r.hits) for r in mined.collect()}


def test_query_equals_brute_force(spark):
    from tidemark.llm.queries import QUERIES, URL_RULES

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    given = {p.page_id: brute_rule(URL_RULES, p.url) for p in pages}
    rules = brute_mine([(p.url, given[p.page_id].block) for p in pages if given[p.page_id]], uf.MIN_SUPPORT, uf.MIN_CONFIDENCE)
    got = {r.page_id: r for r in QUERIES["op12_url_filter"](spark, SF).collect()}
    assert len(got) == len(pages)
    learned = Counter()
    for p in pages:
        r, rule = got[p.page_id], given[p.page_id]
        assert (r.host, r.path) == brute_split(p.url) and r.rule == (rule.text if rule else None)
        if rule:
            assert r.verdict == ("block" if rule.block else "allow")
            continue
        own = set(uf.tokens_of(p.url))
        fit = sorted((-c, -h, len(x), x, lab) for (x, lab), (c, h) in rules.items() if own.issuperset(x))
        assert r.verdict == ("block" if fit and fit[0][4] == uf.BLOCK else "allow")
        assert r.tokens == (list(fit[0][3]) if fit else None)
        learned[r.verdict] += 1
    assert learned["block"] > 50 and learned["allow"] > 50


@pytest.mark.parametrize("seed", [1, 2])
def test_mining_equals_counting_subsets(rows, seed):
    rng = random.Random(seed)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m", "ads") for b in ("one", "two") for c in ("com", "net")]
    data = []
    for _ in range(400):
        h, seg = rng.choice(hosts), rng.choice(["en", "fr", "promo-win", "x"])
        url = f"http{rng.choice(['', 's'])}://{h}/{seg}/{rng.randint(1, 3000)}{rng.choice(['', '.html', '?q=1&r=2', '#a'])}"
        data.append((url, (h.startswith("ads") or seg == "promo-win") if rng.random() < 0.95 else rng.random() < 0.5))
    data += data[:60]
    got = as_dict(uf.mine(rows([(*d, 1) for d in data] + [("u://x/", None, 2)], "url string, block boolean, items int", 4), 0.02, 0.8))
    assert got == brute_mine(data, 0.02, 0.8) and len(got) > 3


def test_no_token_of_a_url_is_left_out(rows):
    """Eleven tokens or more a url, the telling ones among the least telling by themselves."""
    rng = random.Random(4)
    data = []
    for _ in range(300):
        parts = [f"p{i}{rng.randint(0, 1)}" for i in range(6)]
        block = parts[4] == "p41" and parts[5] == "p51"
        data.append((f"http://a.one.com/{'/'.join(parts)}/same-words-here", block))
    want = Counter()
    sets = [(frozenset(uf.tokens_of(u)), b) for u, b in data]
    assert min(len(t) for t, _ in sets) > 11
    got = as_dict(uf.mine(rows(data, "url string, block boolean", 3), 0.05, 0.95))
    assert got[("part:p41", "part:p51"), uf.BLOCK] == (1.0, sum(b for _, b in data))
    for (tokens, label), (confidence, hits) in got.items():
        fit = [b for t, b in sets if t.issuperset(tokens)]
        n = sum(b == (label == uf.BLOCK) for b in fit)
        assert (n / len(fit), n) == (confidence, hits)
        want[label] += 1
    assert want[uf.ALLOW] and want[uf.BLOCK]
    free = sorted({t for x, _ in sets for t in x if t.startswith("part:p")})
    assert [t for t in free if ((t,), uf.ALLOW) in got] == ["part:p40", "part:p50"]


def test_given_rules():
    book = uf.RuleBook([uf.Rule("org/", False), uf.Rule("a.org/x", True), uf.Rule("org/xy", False), uf.Rule("org/xyza/", False)])
    assert book.find("b.a.org", "/x").text == "a.org/x"
    assert book.find("a.org", "/xyza/").text == "org/xyza/"
    assert book.find("za.org", "/x").text == "org/" and book.find("org", "") is None and book.find("xorg", "/") is None
    for url in [None, "", "x", "://", "A://B.C", "a://b?/c", "a://B#x://y", "http://h:80/P?q#f", "a://é.Ü/x\ny"]:
        assert uf.split(url)[1:3] == brute_split(url)


def test_odd_rows(rows):
    rules = [uf.Rule("org/", True)]
    deep = "http://a.org/" + "/".join(f"s{i}" for i in range(3000))
    big = 2**53 + 1
    data = [(big, None), (None, "no url"), (3, deep), (3, deep), (4, "http://b.com/s1/s7"), (5, ""), (6, "http://b.com/z")]
    pages = rows([(k, u, "x", 1.0) for k, u in data], "page_id long, url string, host string, confidence double")
    mined = uf.mine(uf.rule_labels(pages, rules), 0.5, 0.5)
    assert mined.count() <= 2**uf.MAX_ITEMS / 0.5
    got = sorted((r.page_id or 0, r.host, r.verdict) for r in uf.judge(pages, rules, mined).collect())
    assert got[0] == (0, "", "allow") and got[-1] == (big, "", "allow") and got.count((3, "a.org", "block")) == 2
    none = uf.mine(uf.rule_labels(pages, []))
    assert none.count() == 0
    assert {r.verdict for r in uf.judge(pages, [], none).collect()} == {"allow"}
    assert uf.judge(pages.limit(0), rules, none).count() == 0


def test_index_lists_rules_under_their_rarest_token():
    r = [{"tokens": ["a", "b"], "label": uf.BLOCK, "confidence": 0.9, "hits": 5, "rarest": "b"}, {"tokens": ["a"], "label": uf.ALLOW, "confidence": 0.8, "hits": 9, "rarest": "a"}]
    index = uf.RuleIndex(r)
    assert {t: len(x) for t, x in index.of.items()} == {"a": 1, "b": 1}
    assert index.best(["a", "b"])["label"] == uf.BLOCK and index.best(["a"])["label"] == uf.ALLOW and index.best(["b"]) is None
