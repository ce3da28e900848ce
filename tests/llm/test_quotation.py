import random
import re
from collections import Counter

from statedit.llm import quotation as Q

SCHEMA = "conv_id long, turn long, role string, text string, body string, unit long"


def parse(text):
    out = []
    for line in re.sub("\r\n?", "\n", text or "").split("\n"):
        m = re.match(r"^[ \t]*((?:>[ \t]?)+)", line)
        out.append((m.group(1).count(">"), line[m.end():]) if m else (0, line))
    return out


def normal(t):
    return re.sub(r"[\W_]+", " ", t.lower()).strip()


def units(t):
    return {normal(x) for x in [t, *re.split(r"\n[ \t]*\n", t), *t.split("\n")]} - {""}


def brute(rows):
    body = {(c, t): "\n".join(x for n, x in parse(text) if n == 0).strip() for c, t, _, text in rows}
    parent = {}
    for c, t, _, text in rows:
        runs = []
        for n, x in parse(text):
            if runs and runs[-1][0] == n:
                runs[-1][1].append(x)
            else:
                runs.append((n, [x]))
        found = []
        for n, lines in runs:
            for u in units("\n".join(lines)) if n else ():
                at = min((t2 for (c2, t2), b in body.items() if c2 == c and u in units(b)), default=None)
                if at is not None and at < t:
                    found.append((n, -at))
        if found:
            parent[c, t] = -min(found)[1]
    out = []
    for c, t, _, text in rows:
        root, depth = t, 0
        while (c, root) in parent:
            root, depth = parent[c, root], depth + 1
        out.append((c, root, t, body[c, t], max(n for n, _ in parse(text)), parent.get((c, t)), depth))
    position, seen = {}, Counter()
    for c, root, t, *_ in sorted(out, key=lambda r: r[:3]):
        position[c, t] = seen[c]
        seen[c] += 1
    return sorted((c, position[c, t], t, b, n, p, root, d) for c, root, t, b, n, p, d in out)


def corpus():
    rng = random.Random(11)
    rows = []
    for c in range(12):
        said = []
        for t in range(rng.randint(1, 14)):
            own = "\n".join(" ".join(rng.choices("Alpha beta, gamma delta. eps".split(), k=rng.randint(2, 5))) + f" {t}{c}" for _ in range(rng.randint(1, 3)))
            text = own
            if said and rng.random() < 0.7:
                quoted = rng.choice(said)
                lines = quoted.split("\n") if rng.random() < 0.6 else rng.sample(quoted.split("\n"), 1)
                text = "\n".join(rng.choice(["> ", ">", " >"]) + x.upper() for x in lines) + "\n" + own
            if rng.random() < 0.1:
                text += "\n> nobody said this"
            said.append(text)
            rows.append((c, t, "user", text))
    return rows + [(100, 0, "user", None), (100, 1, "user", ""), (100, 2, None, ">>> \r\n>"), (101, 0, "a", "word " * 20_000), (101, 5, "b", "> " + "word " * 20_000)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    got = Q.link_quotes(df).collect()
    assert sorted((r.conv_id, r.position, r.turn, r.body, r.quote_levels, r.parent_turn, r.root_turn, r.depth) for r in got) == brute(rows)
    assert sum(r.depth > 1 for r in got) > 5 and not any(line.lstrip().startswith(">") for r in got for line in r.body.split("\n"))


def test_nested_levels(spark):
    rows = [(1, 0, "u", "Where is it?"), (1, 1, "a", "> where is IT\nOver there."), (1, 2, "u", ">> Where is it?\n> Over there.\nThanks!"), (1, 3, "a", ">> Where is it?\nAgain.")]
    got = {r.turn: r for r in Q.link_quotes(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)).collect()}
    assert [got[t].parent_turn for t in range(4)] == [None, 0, 1, 0] and [got[t].depth for t in range(4)] == [0, 1, 2, 1]
    assert [got[t].quote_levels for t in range(4)] == [0, 1, 2, 2] and got[2].body == "Thanks!"


def test_empty_null_and_repeated_rows(spark):
    assert Q.link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(None, 0, "u", "Hi", "", 1), (None, 1, "u", "> Hi\nyes", "", 1), (5, None, "u", "Hi", "", 1), (5, 1, "u", "a", "", 1), (5, 1, "u", "a", "", 1), (5, 2, "u", "> a", "", 1)]
    got = Q.link_quotes(spark.createDataFrame(odd, SCHEMA)).collect()
    assert len(got) == 6 and sorted((str(r.conv_id), r.position) for r in got) == [("5", 0), ("5", 1), ("5", 2), ("5", 3), ("None", 0), ("None", 1)]
    assert Counter(r.parent_turn for r in got) == {None: 5, 1: 1}


def test_long_quotes_are_linear(spark):
    """Twenty thousand quoted lines of two levels in turn."""
    lines = [("> " if i % 2 else "> > ") + f"line {i}" for i in range(20_000)]
    df = spark.createDataFrame([(1, 1, "a", "line 7"), (1, 2, "b", "\n".join(lines) + "\nwell")], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.parent_turn, r.body, r.quote_levels) for r in Q.link_quotes(df).collect()}
    assert got[2] == (1, "well", 2)


def test_query_links_quotes(spark, tmp_path):
    rows = [(c, t, "u", f"message {t} of {c}\nsecond line") for c in (1, 2, None) for t in range(1, 6)] + [(1, 2, "u", "message 2 of 1, again"), (1, 6, "u", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r.conv_id, r.turn, r.parent_turn) for r in Q.op4_quotation_linking(spark, str(tmp_path)).where("conv_id is not null").collect())
    links = {1: None, 2: 1, 3: None, 4: 3, 5: None}
    assert got == sorted([(c, t, p) for c in (1, 2) for t, p in links.items()] + [(1, 2, 1), (1, 6, 5)], key=str) or set(got) == {
        *((c, t, p) for c in (1, 2) for t, p in links.items()), (1, 6, 5)}
