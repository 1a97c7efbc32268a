import random

from tandem.llm import url_filter


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:at], rest[at:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_against_all_rules(table, monkeypatch):
    rng = random.Random(4)
    labels = ["a", "b", "com", "net", "É", "x-y"]
    word = lambda: rng.choice(labels)
    rules = list({(".".join(word() for _ in range(rng.randint(1, 3))), "/" * rng.randint(0, 1) + "ab"[: rng.randint(0, 2)]): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [
        rng.choice(["http://", "HTTPS://", "://", ""]) + ".".join(word() for _ in range(rng.randint(1, 4))).upper()
        + rng.choice(["", "/", "/a", "/ab/c", "?q=/a", "#/b", "/a?x://y", ":80/ab"]) for _ in range(400)
    ] + [None, "", "http://", "://", "x" * 5000, "http://a/" + "b" * 50_000, "http://..a./a", "http://a.net\n/ab"]
    pages = table([(i, u, "clash", 0) for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule int")
    listed = table([*rules, *rules[:5], (None, "/", "block")], "host string, path string, verdict string")
    for most in (1, 1 << 16):  # a full filter lets all pass: same result
        monkeypatch.setattr(url_filter, "MAX_BLOCKS", most)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
        assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty_tables_and_repeated_rows(table):
    listed = table([("net", "/", "block"), ("net", "/", "allow")], "host string, path string, verdict string")
    pages = table([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, None)], "page_id bigint, url string")
    got = sorted(map(tuple, url_filter.judge(pages, listed).collect()), key=str)
    assert got == sorted([(1, "a.net", "/x", "net/", "block")] * 2 + [(None, "", "", None, "allow")], key=str)
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0)).collect()} == {"allow"}


def test_filter_drops_most_strangers(table):
    listed = table([(f"h{i}.com", "/", "block") for i in range(2000)], "host string, path string, verdict string")
    blocks = url_filter.bloom_blocks(listed, 128)
    strangers = table([(f"s{i}.com", "/") for i in range(4000)], "host string, path string")
    hit = url_filter._hashed(strangers, 128).join(blocks, "_block")
    for i in range(8):
        hit = hit.where(f"(_w{i} & _b{i}) <> 0")
    assert blocks.count() <= 128 and hit.count() < 100
