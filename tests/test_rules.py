"""Rules without SQL against plain versions: corrections, shapes, passes, chosen groups, logs told apart, caches that go on."""

from __future__ import annotations

import random
import re
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from timberline.operators import augment, build, cache, clean, miners, online, reports, sampling
from timberline.plans import catalog
from timberline.sources import files

SMALL = "/root/testdata/sf0.001"


def plain_corrected(template, full):
    """Correction rule by rule, token by token."""
    t = re.sub(r"\s+", " ", template.strip())
    ends = r"""\s,!;:=|"'\[\](){}"""
    if full:
        t = "".join("<*>" if re.fullmatch(r"(/[^/]+)+", x) else x for x in re.split(f"([{ends}])", t))
    out = []
    for x in re.split(rf"([{ends}.\-+@#$%&])", t):
        if full and x.lower() in ("true", "false", "null", "root", "admin") or re.fullmatch(r"\d+", x):
            x = "<*>"
        if re.fullmatch(r"[^\s/]*<\*>[^\s/]*", x):
            x = "<*>"
        out.append(x)
    t = "".join(out)
    for pattern in (r"<\*>\.<\*>", r"<\*><\*>"):
        while re.search(pattern, t):
            t = re.sub(pattern, "<*>", t)
    return t


HARD = ["a  b\t<*>", "x=/var/log/a.b, TRUE root-ed admin", "1.2.3 4-5 v6", "<*>.<*>.<*> <*><*>x", "a/<*> <*>/<*> 9/", "'null' (root) \"admin\" Root", "/a//b /c/ /d e/f", "user12 12user 12", "", "<*>", "a.<*>.b <*>:<*>"]


def test_fully_corrected(spark):
    rows = spark.createDataFrame(list(enumerate(HARD)), "i int, t string").select("i", clean.fully_corrected(F.col("t")).alias("t"))
    assert {r.i: r.t for r in rows.collect()} == {i: plain_corrected(t, True) for i, t in enumerate(HARD)}


def test_post_processed(spark):
    cases = {"{name}: {x}": None, "a {name} b": "a <*> b", "- 5 7.": None, "move 0xab to 10.2.3.4:80": "move <*> to <*>", "mac aa:bb:cc:dd:ee": "mac <*>", 'executed cmd "ls -l" now': "executed cmd <*> now"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", clean.post_processed(F.col("t")).alias("p"))
    assert {r.t: r.p for r in rows.collect()} == cases


def test_bare_words(spark):
    def plain(s):
        s = re.sub(r"""[:()=,"{}@\[\]|;.]""", " ", s)
        s = " ".join(w.lower() if w.isupper() else w for w in s.split())
        s = re.sub("([A-Z][a-z]+)", r" \1", re.sub("([A-Z]+)", r" \1", s))
        s = " ".join(w for w in s.split() if not re.search(r"\d", w)).translate(str.maketrans(dict.fromkeys(string.punctuation)))
        return " ".join(w.lower() for w in s.split())

    cases = ["HTTPServer startedOK: getUser(x1)", "A B c", "", "  IO-Error in /var/logDir $x$ ", "ABCdef XML2", "a_b-c!"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", clean.bare_words(F.col("t")).alias("p"))
    assert {r.t: r.p for r in rows.collect()} == {c: plain(c) for c in cases}


def test_kinds_of_tokens(spark):
    cases = {"": (None, True), "+5": ("positive", False), "5": ("positive", True), "-5": ("negative", True), "*": ("placeholder", True), "a<*>": ("placeholder", True), "[10.0.0.1]:": ("ip", True), "10:11:12": ("time", True), "(/a/b)": ("path", False), "/a": ("path", True), "x://y": ("url", True), "word": (None, False)}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", clean.variable_type(F.col("t")).alias("k"), clean.is_variable(F.col("t")).alias("v"))
    assert {r.t: (r.k, r.v) for r in rows.collect()} == cases


def test_structural_variants(spark):
    seeds = [(1, "2005-06-03 10:11:12 core.12 at 10.251.73.220 blk_123456789012345678 took 7 ms"), (2, "no numbers here"), (3, "port 50010")]
    table = spark.createDataFrame(seeds, "line_id bigint, content string")
    got = defaultdict(list)
    for r in augment.StructuralVariants().variants(table, 3).collect():
        got[r.origin].append(r.variant)
    assert set(got) == {1, 3} and all(len(set(v)) == len(v) <= 3 for v in got.values())
    for v in got[1]:
        assert re.fullmatch(r"2005-(0[1-9]|1[0-2])-(0[1-9]|1[0-2]) (0[1-9]|1[0-2]):\d\d:\d\d core\.\d\d at \d\d\.1\d\d\.\d\d\.1\d\d blk_\d{18} took \d ms", v), v


def test_cached_variants(spark, tmp_path):
    asked = []

    class Source:
        def variants(self, seeds, count):
            asked.append(sorted(r.content for r in seeds.collect()))
            return seeds.where("content != 'none'").select(F.col("line_id").alias("origin"), "content", F.concat("content", F.lit("!")).alias("variant"))

    source = augment.CachedVariants(Source(), f"file://{tmp_path}/kept")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "none")], "line_id bigint, content string")
    want = [(1, "a!"), (2, "b!"), (3, "a!")]
    for _ in range(2):
        assert sorted((r.origin, r.variant) for r in source.variants(first, 2).collect()) == want
    more = first.unionByName(spark.createDataFrame([(5, "c")], "line_id bigint, content string"))
    assert len(source.variants(more, 2).collect()) == 4
    assert asked == [["a", "b", "none"], ["c"]]


def test_shape_clusters(spark):
    rng = random.Random(1)
    rows = [(i, f"e{rng.randrange(3)}", rng.choice([f"open {rng.randrange(4)}", f"close file{rng.randrange(3)} now", f"ip 10.0.0.{rng.randrange(3)}"])) for i in range(60)]

    def shape(t):
        for pattern, by in clean.SHAPE:
            t = re.sub(pattern, by, t)
        return t.strip()

    want = set()
    for e in {r[1] for r in rows}:
        groups = defaultdict(list)
        for i, k, t in rows:
            if k == e:
                groups[shape(t)].append((i, t))
        seen = set()
        for i, t in max(groups.values(), key=len):
            if t not in seen and len(seen) < 2:
                seen.add(t)
                want.add((e, i))
    got = sampling.shape_clusters(spark.createDataFrame(rows, "line_id bigint, event string, content string"), "event", 2)
    assert {(r.event, r.line_id) for r in got.collect()} == want


def plain_passes(texts, threshold):
    """Distinct texts after each pass, over all lengths at once."""
    held, out = set(texts), []
    while held:
        split = {t: re.findall(r"\S+=|\S+", t) for t in held}
        counts = Counter((len(w), k, x) for w in split.values() for k, x in enumerate(w) if x != "<*>")
        low = min(counts.values(), default=0)
        after = set()
        for t, w in split.items():
            new = ["<*>" if x == "<*>" or counts[len(w), k, x] == low else x for k, x in enumerate(w)]
            if new.count("<*>") / len(new) <= threshold and counts:
                after.add(" ".join(new))
        held = after
        out.append(len(held))
    return out


def test_trace(spark):
    rng = random.Random(4)
    texts = [f"job {rng.randrange(6)} on host{rng.randrange(3)} {rng.choice(['ok', 'failed'])}" for _ in range(40)] + [f"start unit{k % 7} now" for k in range(20)] + ["idle"] * 3
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id bigint, content string")
    got = [(r.step, r.n) for r in miners.trace(lines, threshold=0.6).collect()]
    cleaned = {r.t for r in lines.select(clean.anchor_text(F.col("content")).alias("t")).collect()}
    want = plain_passes(cleaned, 0.6)
    assert got == [("initial", len(set(texts))), ("cleaned", len(cleaned)), *((f"pass {k}", n) for k, n in enumerate(want, 1))]


def test_chosen_groups_and_adaptive(spark):
    rows = [(i, f"user {i % 2} logged in") for i in range(10)] + [(20 + i, f"disk {i} full") for i in range(8)] + [(40, "boot")]
    lines = spark.createDataFrame(rows, "line_id bigint, content string")
    got = [(r["rank"], r.key, r.group_size, r.line_id) for r in miners.chosen_groups(lines, below=0.9).orderBy("rank").collect()]
    assert got == [(1, "boot", 1, 40), (2, "user <*> logged in", 10, 0)]
    seen = []

    class Source:
        def variants(self, seeds, count):
            seen.extend((r.line_id, r.content) for r in seeds.collect())
            return seeds.withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(count)))).select(F.col("line_id").alias("origin"), "content", F.concat("content", F.lit(" v"), "v").alias("variant"))

    found, told = miners.adaptive(lines, source=Source(), trigger=1.0, variants=2)
    assert {r.line_id for r in found.collect()} == {i for i, _ in rows}
    told = told.first()
    assert (told.enabled, told.generated_lines, told.coarse_groups, told.input_lines) == (True, 2 * len(seen), 3, 19)
    _, off = miners.adaptive(lines, source=Source(), trigger=0.0)
    assert not off.first().enabled


@pytest.mark.parametrize("miner", [miners.brain, miners.by_anchors, online.drain, online.spell])
def test_logs_told_apart(spark, miner):
    one = [(i, f"send {i % 3} bytes to host{i % 4}") for i in range(30)]
    two = [(i, f"send {i} packets to host1") for i in range(15)] + [(50, "send 3 bytes to host1")]
    kinds = "line_id bigint, content string"
    alone = {n: {(r.line_id, r.template) for r in miner(spark.createDataFrame(rows, kinds)).collect()} for n, rows in (("a", one), ("b", two))}
    both = spark.createDataFrame([("a", *r) for r in one] + [("b", *r) for r in two], f"name string, {kinds}")
    got = defaultdict(set)
    for r in miner(both, key=["name"]).collect():
        got[r.name].add((r.line_id, r.template))
    assert got == alone


def plain_brain(contents, threshold):
    words = [c.split(" ") for c in contents]
    freq = Counter((k, w) for ws in words for k, w in enumerate(ws))
    groups, out = defaultdict(list), {}
    for i, ws in enumerate(words):
        f = [freq[k, w] for k, w in enumerate(ws)]
        times = max(Counter(f).values())
        root = next(x for x in f if f.count(x) == times)
        groups[len(ws), root, times].append(i)
    for (n, root, _), members in groups.items():
        lead = words[members[0]]
        varying = set()
        for k in range(n):
            if freq[k, lead[k]] != root:
                kinds = {words[i][k] for i in members}
                if len(kinds) >= threshold:
                    varying |= kinds
        for i in members:
            out[i] = " ".join("<*>" if w in varying or "/" in w or "<*>" in w or re.fullmatch(r"-?\d+", w) else w for w in words[i])
    return out


def test_brain_against_a_plain_version(spark):
    rng = random.Random(3)
    pool = ["alpha", "beta", "gamma", "delta", "eps"]
    contents = [f"{rng.choice(['get', 'put'])} {rng.choice(pool)} from {rng.choice(pool)} {rng.choice(['a/b', '7', 'ok'])}" for _ in range(150)] + [f"x {rng.choice(pool)}" for _ in range(40)]
    for threshold in (2, 4):
        got = {r.line_id: r.template for r in miners.brain(spark.createDataFrame(list(enumerate(contents)), "line_id bigint, content string"), threshold=threshold).collect()}
        assert got == plain_brain(contents, threshold)


def test_a_cache_goes_on(spark):
    rows = [(i, f"open file{i} by user {i % 3}") for i in range(8)] + [(20 + i, f"close {i} quickly") for i in range(6)]
    kinds = "line_id bigint, content string"
    empty = spark.createDataFrame([], "cache string, number bigint, template string")
    whole = {r.line_id: r.number for r in cache.cached(spark.createDataFrame(rows, kinds), known=empty).collect()}
    first = cache.cached(spark.createDataFrame(rows[:9], kinds), known=empty).persist()
    held = cache.templates_of(first, empty).persist()
    rest = cache.cached(spark.createDataFrame(rows[9:], kinds), known=held)
    assert {**{r.line_id: r.number for r in first.collect()}, **{r.line_id: r.number for r in rest.collect()}} == whole
    assert {r.number for r in cache.templates_of(rest, held).collect()} == set(whole.values())


def test_readers(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("模板,句子标号\na <*> b,\"1,2,x\"\n\"c, d\",3\n".encode("gbk"))
    (tmp_path / "u.csv").write_bytes("template,ids\ne,\"4, 5\"\n".encode("utf-8-sig"))
    got = sorted((r.template, r.line_ids) for name in ("g", "u") for r in files.read_groups(spark, f"{tmp_path}/{name}.csv").collect())
    assert got == [("a <*> b", [1, 2]), ("c, d", [3]), ("e", [4, 5])]
    (tmp_path / "t.csv").write_bytes("EventId,EventTemplate\nE1,é <*>\nE2,\nE3,\"a, b\"\n".encode("latin-1"))
    assert sorted((r.event_id, r.template) for r in files.read_templates(spark, f"{tmp_path}/t.csv").collect()) == [("E1", "é <*>"), ("E3", "a, b")]
    (tmp_path / "l.log").write_text("`one`\n\n two `\nthree\n")
    assert [r.line for r in files.read_log(spark, f"{tmp_path}/l.log").orderBy("line_id").collect()] == ["one", "two ", "three"]
    assert files.count_lines(spark, f"{tmp_path}/l.log") == 4 and files.count_lines(spark, f"{tmp_path}/none.log") == -1
    (tmp_path / "h.log").write_text("17/06/09 20:10:40 INFO a.B: grüße 5\nbad\n17/06/09 20:10:41 INFO a.B: end\n")
    rows = files.load_log(spark, f"{tmp_path}/h.log", "<Date> <Time> <Level> <Component>: <Content>").orderBy("number").collect()
    assert [(r.number, r.Content) for r in rows] == [(1, "gr<N/ASCII>e 5"), (2, "end")]


def test_tables(spark, tmp_path):
    lines = spark.createDataFrame([(1, "a 1"), (2, "a 2"), (3, "b")], "line_id bigint, content string")
    found = files.structured(lines, miners.by_mask(lines, (r"\d",)))
    got = {r.event_template: (r.event_id, r.occurrences) for r in files.templates_table(found).collect()}
    assert {t: n for t, (_, n) in got.items()} == {"a <*>": 2, "b": 1}
    reports.write_table(lines.coalesce(1), f"{tmp_path}/out")
    raw = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert raw.decode("utf-8-sig").splitlines()[0] == "line_id,content" and raw.startswith(b"\xef\xbb\xbf")


def test_target_counts_are_the_closest():
    for total in (4, 7, 10):
        for target in (0.0, 0.2, 0.5, 0.77, 1.0):
            counts = build.target_counts(total, target)
            assert sum(counts) == total and all(c > 0 for c in counts)
            options = [build.balanced(total, p) for p in range(1, total + 1)] + [[top, *build.balanced(total - top, p - 1)] for p in range(2, total + 1) for top in range(-(-total // p), total - p + 2)]
            assert abs(build.entropy(counts) - target) <= min(abs(build.entropy(o) - target) for o in options) + 1e-12


def test_ratios(spark):
    pairs = spark.createDataFrame([("abcd", "bcde"), ("", "a"), ("same", "same")], "a string, b string")
    assert [round(r.similarity, 6) for r in sampling.matching_blocks_ratio(pairs, "a", "b").collect()] == [0.75, 0.0, 1.0]


def test_every_kind_of_refusal_occurs(spark):
    q = catalog.queries()
    reasons = {r.reason for r in q["p10_reject_reasons"](spark, SMALL).select("reason").distinct().collect()}
    assert len(reasons) == 7 and None in reasons
    assert {r.outcome for r in q["a20_outcomes"](spark, SMALL).collect()} == {"SM", "OG", "UG", "MX"}
