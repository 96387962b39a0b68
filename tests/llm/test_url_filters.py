import math
import random
import re
from collections import Counter, defaultdict

import duckdb
from seclake.llm import queries, url_filters
from seclake.llm.url_filters import UrlRule

RULES = [UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("block", "bad.net")]


def parse(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def fitting(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def brute(rows, rules, reject=0.6, weight=4.0, min_branches=16, thin=4.0, z=2.0):
    """The same decisions with dictionaries, one node after another from the root of each host."""
    parsed, count = [], defaultdict(lambda: [0, 0, 0])
    for i, url in rows:
        host, path = parse(url)
        rule = fitting(host, path, rules)
        shape = re.sub("[0-9]+", "#", re.sub(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "#", path))
        parsed.append((i, host, path, rule, shape))
        c = count[host, shape]
        c[0] += 1
        c[1] += rule is not None and rule.verdict == "block"
        c[2] += rule is not None
    labelled = sum(c[2] for c in count.values())
    overall = min(sum(c[1] for c in count.values()) / labelled, reject / 2) if labelled else 0.0
    purity = {}

    def close(group, prior):
        share = (sum(count[k][1] for k in group) + weight * prior) / (sum(count[k][2] for k in group) + weight)
        purity.update(dict.fromkeys(group, share))

    def open_node(group, rest, prior, level):
        n, blocked, lab = (sum(count[k][j] for k in group) for j in range(3))
        if lab == 0 or lab == n or len(group) == 1:
            close(group, prior)
            return
        above = (blocked + weight * prior) / (lab + weight)
        ended = [k for k in group if len(rest[k]) <= level]
        if ended:
            close(ended, above)
        branches = defaultdict(list)
        for k in group:
            if len(rest[k]) > level:
                branches[rest[k][level]].append(k)
        def kids(keys):
            out = Counter()
            for k in keys:
                out[rest[k][level + 1] if len(rest[k]) > level + 1 else ""] += count[k][0]
            return out
        names, p = {}, blocked / lab
        for b, keys in branches.items():
            nb, bb, lb = (sum(count[k][j] for k in keys) for j in range(3))
            if len(branches) >= min_branches and n < thin * len(branches):
                names[b] = "*"
            elif lb == 0:
                names[b] = "*?"
            else:
                names[b] = "*=" if abs(bb / lb - p) <= z * math.sqrt(p * (1 - p) / lb) + 1e-12 else b
        pooled = kids([k for b, keys in branches.items() if names[b] == "*=" for k in keys])
        for b in [b for b in branches if names[b] == "*?"]:
            own = kids(branches[b])
            if pooled:
                r = math.sqrt(sum(pooled.values()) / sum(own.values()))
                kinds = set(own) | set(pooled)
                statistic = sum((own[c] * r - pooled[c] / r) ** 2 / (own[c] + pooled[c]) for c in kinds)
                if statistic <= len(kinds) - 1 + z * math.sqrt(2 * (len(kinds) - 1)) + 1e-9:
                    names[b] = "*="
        merged = defaultdict(list)
        for b, keys in branches.items():
            merged[names[b]] += keys
        for keys in merged.values():
            open_node(keys, rest, above, level + 1)

    rest = {k: k[1].split("/")[1:] if k[1].startswith("/") else k[1].split("/") for k in count}
    for host in {h for h, _ in count}:
        open_node([k for k in count if k[0] == host], rest, overall, 0)
    out = Counter()
    for i, host, path, rule, shape in parsed:
        verdict = rule.verdict if rule else "block" if purity[host, shape] >= reject else "allow"
        out[(i, host, path, rule and rule.host + rule.path, verdict)] += 1
    return out


def table(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")


def judged(df):
    return Counter(map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect()))


def test_equals_brute_force(spark):
    dice = random.Random(1)
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/en/x?q#f", "http://example.com", "x://com/", "x://bad.net", "x://sub.BAD.net:80/a?b", "x://notbad.net/", "a://b://c/d", "x://h#/y", "x://É.com/ü",
            "x://deep.org" + "/a" * 3000, "x://deep.org" + "/a" * 12 + "/b", "x://uuid.org/123e4567-e89b-12d3-a456-426614174000/z"]
    for _ in range(1500):
        host = dice.choice(["hot.org", "hot.org", "hot.org", "a.net", "x.example.com", "y.example.com", "q.com"])
        path = dice.choice(["/en/", "/de/", "/shop/", "/slug/"]) + dice.choice(["a", "b", f"{dice.randint(1, 99)}", f"w{dice.choice('abcdefghij')}{dice.choice('abcdefghij')}x"]) + dice.choice(["", "/", ".html"])
        urls.append(f"https://{host}{path}")
    rules = [*RULES, UrlRule("block", "hot.org", "/shop/a"), UrlRule("block", "hot.org", "/shop/b"), UrlRule("allow", "hot.org", "/de/a"), UrlRule("block", "hot.org", "/slug/wa"), UrlRule("block", "hot.org", "/slug/wb"), UrlRule("block", "hot.org", "/slug/wc"), UrlRule("block", "hot.org", "/slug/wd")]
    want = brute(list(enumerate(urls)), rules)
    assert judged(url_filters.judge_urls(table(spark, urls), rules)) == want
    assert {v for (_, _, _, rule, v) in want if rule is None} == {"allow", "block"}


def test_empty_and_unruled(spark):
    assert judged(url_filters.judge_urls(table(spark, ["x://a/b"]).where("page_id < 0"), RULES)) == Counter()
    assert judged(url_filters.judge_urls(table(spark, [None, "x://a/b"]), [])) == Counter({(0, "", "", None, "allow"): 1, (1, "a", "/b", None, "allow"): 1})


def test_branches_are_judged_by_what_follows_them(spark):
    """Unlabelled branches join the labelled ones where the same follows them; otherwise their surroundings decide."""
    urls = [f"x://a.org/{b}/{n}" for b in ("spam", "junk", "new") for n in ("x", "y", "x", "y", "x", "z")] * 3
    urls += [f"x://a.org/news/{n}" for n in ("p", "q", "r", "s")] * 6 + [f"x://a.org/good/{n}/w" for n in "pqr"] * 12
    rules = [UrlRule("block", "a.org", "/spam"), UrlRule("block", "a.org", "/junk"), UrlRule("allow", "a.org", "/good"), UrlRule("allow", "b.org")]
    want = brute(list(enumerate(urls)), rules)
    assert judged(url_filters.judge_urls(table(spark, urls), rules)) == want


def test_long_paths_are_followed_as_far_as_there_is_something_to_decide(spark):
    urls = [f"x://a.org/{'s/' * 9}{n}" for n in "bcd" for _ in range(5)] + ["x://a.org/" + "u/" * 2000, "x://a.org/" + "v/" * 2000]
    rules = [UrlRule("block", "a.org", "/" + "s/" * 9 + "b"), UrlRule("allow", "a.org", "/" + "s/" * 9 + "c")]
    assert judged(url_filters.judge_urls(table(spark, urls), rules)) == brute(list(enumerate(urls)), rules)


def test_verdicts_of_hidden_rules_are_found_again(spark):
    """One of two like paths of each host has no rule; it gets the verdict of the other."""
    dice = random.Random(3)
    hosts = [f"h{i}.org" for i in range(20)]
    urls = [f"x://{h}/{b}/{dice.choice(['', 'item'])}{dice.randrange(90)}{dice.choice(['', '.html'])}" for h in hosts for b in ("es", "fr", "fr2") for _ in range(8)]
    rules = [UrlRule("block" if i % 2 else "allow", h, f"/{b}/") for i, h in enumerate(hosts) for b in ("es", "fr/")]
    out = url_filters.judge_urls(table(spark, urls), [UrlRule(r.verdict, r.host, r.path.replace("//", "/")) for r in rules]).where("rule IS NULL").collect()
    right = sum(r.verdict == ("block" if int(r.host[1:-4]) % 2 else "allow") for r in out)
    assert len(out) == 160 and right >= 0.95 * len(out)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT page_id, url FROM '{sf}/pages.parquet'").fetchall()
    assert judged(queries.QUERIES["op3_url_filters"](spark, sf)) == brute(rows, queries.URL_RULES)
