"""HTML extraction and chat formatting."""

import html
import math
import random
import re
import time
from collections import Counter

import pytest

from quillon.llm import chat_formatting as chat
from quillon.llm.html_extraction import Page, html_extraction, style_tree

PAGES = {
    "<article><h1>A&amp;B</h1><p>x  y\n z<p>q<br>r</article><footer>&copy;</footer>": "A&B\nx y z\nq r",
    "<body><nav><a href=/>menu</a></nav><div class='ad'>buy</div><main>text <b>bold</b>er<script>var a='</p>'</script></main>": "text bolder",
    "<article>one<section class='comments'><article>reply</article></section><form>f</form>two</article>": "one\ntwo",
    "<header>site</header><article><header><h1>T</h1></header>b</article>": "T\nb",
    "<p>a<ul><li>1<li>2</ul><table><tr><td>c<td>d</table>": "a\n1\n2\nc\nd",
    "a < b &lt; c &#233; &nbsp; d <!-- x --> e": "a < b < c é d e",
    "<div hidden>no</div><div role=navigation>no</div><div style='display: none'>no</div>yes": "yes",
    "<style>p{}</style><title>t</title><noscript>n</noscript><p title='a>b'>k": "k",
    "<p>cut &amp": "cut &",
    "<article>": "",
    "": "",
    "<!-- open": "",
    "<script>open": "",
    "<p>x</p": "x",
}


@pytest.mark.parametrize("source", PAGES)
def test_pages(source):
    assert Page(source).text(set()) == PAGES[source]


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        want[r.page_id] = "\n".join(t for t in texts if t)
    got = html_extraction(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_style_tree_removes_what_a_host_repeats(spark):
    rows = [(i, f"http://H.com/{i}", f"<div><p>text {i}</p></div><div class=x>Same here</div><span>{i}</span>") for i in range(12)] + [(90, "http://other.com/", "<div class=x>Same here</div>"), (99, None, None)]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id bigint, url string, html string, noise string")
    got = {r.page_id: r.text for r in html_extraction(pages).collect()}
    assert got == {i: f"text {i}\n{i}" for i in range(12)} | {90: "Same here", 99: ""}
    assert html_extraction(pages.limit(0)).count() == 0


def test_importance_is_entropy(spark):
    pages = spark.createDataFrame([("h", f"<p>{i % 2}</p>") for i in range(16)], "host string, html string")
    (row,) = style_tree(pages).collect()
    # two texts on eight of sixteen pages each, and two unseen pages: 1 - log 8 / log 18; one presentation: 0
    assert row.m == 16 and row.importance == pytest.approx(0.9 * (1 - math.log(8) / math.log(18)))


def test_references_and_classes_and_depth():
    assert Page("<p>AT&<b>amp;</b>T</p>1 &<!-- c -->lt; 2").text(set()) == "AT&amp;T\n1 &lt; 2"
    assert Page("<article><div class='form-factor'>a</div><p class='share-price x'>b</p><p class='share-buttons'>c</p><p class='ad-slot'>d</p></article>").text(set()) == "a\nb"
    assert Page("<table><tr><td>1<tr><td>2</table><ul><li>3<ul><li>4</ul><li>5</ul>").text(set()) == "1\n2\n3\n4\n5"
    began = time.perf_counter()
    deep = Page("<div>" * 200_000 + "core" + "</p></div>" * 200_000)
    assert deep.text(set()) == "core"
    assert Page("<p>a<table>" + "<div>" * 100_000 + "b").text(set()) == "a\nb"
    assert time.perf_counter() - began < 20


def brute_importance(pages):
    """host -> path -> composite importance, by plain trees of named paths."""
    out = {}
    for host in {h for h, _ in pages}:
        trees = [blocks(source) for h, source in pages if h == host]
        different = {tuple(t[0]): t for t in trees}.values()
        for path in {p for t in different for p, _ in t[0]}:
            having = [t for t in different if any(p == path for p, _ in t[0])]
            m = len(having)
            count = Counter(text for t in having for text in {x for p, x in t[0] if p == path})
            own = 1 - sum(math.log(n) for n in count.values()) / len(count) / math.log(m + 2)
            above = path.rpartition("/")[0]
            shapes = Counter(t[1][above] for t in different if any(p.rpartition("/")[0] == above for p, _ in t[0]))
            total = sum(shapes.values())
            style = -sum(n / total * math.log(n / total) for n in shapes.values()) / math.log(total) if total > 1 else 1.0
            out[host, path] = 0.1 * style + 0.9 * own
    return out


def blocks(source):
    """((path, text), ...) and path -> different child names, of sources made of <div> and <p> only."""
    found, children, stack, at = [], {}, [""], 0
    for m in re.finditer(r"<(/?)(\w+)>|([^<]+)", source):
        if m[3]:
            found.append(("/".join(stack), m[3].strip()))
        elif m[1]:
            stack.pop()
        else:
            path = "/".join(stack)
            children[path] = children.get(path, ())
            if m[2] not in children[path]:
                children[path] += (m[2],)
            stack.append(m[2])
    return found, children


def test_importance_matches_brute_force_on_random_sites(spark):
    rng = random.Random(5)

    def page():
        inner = "".join(f"<p>{rng.choice('abc')}</p>" for _ in range(rng.randint(1, 2)))
        return f"<div>{inner}</div>" + rng.choice(["", "<ul>same</ul>", f"<ul>{rng.choice('xyz')}</ul>", "<h6>foot</h6>"])

    pages = [(rng.choice(["one", "two", "three"]), page()) for _ in range(40)]
    got = sorted(round(r.importance, 9) for r in style_tree(spark.createDataFrame(pages, "host string, html string"), copies=False).collect())
    assert got == sorted(round(v, 9) for v in brute_importance(pages).values()) and len(set(got)) > 5


def test_style_tree_judges_pages_with_an_article(spark):
    # the text stands beside a teaser that the site repeats
    teaser = [(i, f"http://t.com/{i}", f"<div><p>text {i}</p></div><article class=teaser>Buy now</article>") for i in range(8)]
    # inside the article, a line of the template; four copies of one page are no template
    inside = [(20 + i, f"http://i.com/{i}", f"<article><p>text {max(i, 3)}</p><h6>All rights reserved</h6></article>") for i in range(12)]
    # nothing but copies: nothing is known of the template
    same = [(40 + i, f"http://s.com/{i}", "<main><p>only text</p></main>") for i in range(12)]
    pages = spark.createDataFrame(teaser + inside + same, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extraction(pages).collect()}
    assert got == {i: f"text {i}" for i in range(8)} | {20 + i: f"text {max(i, 3)}" for i in range(12)} | {40 + i: "only text" for i in range(12)}


# chats


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")


def test_roles_are_recovered(conversations):
    rows = chat.chat_formatting(conversations).collect()
    total, found, agreed = (sum(r[c] for r in rows) for c in ("n_turns", "n_parsed", "n_agreed"))
    assert total == conversations.count() and agreed >= 0.98 * total and abs(found - total) <= 0.02 * total


def test_plain_transcripts(spark, conversations):
    model, *_ = chat.fit(chat.transcripts(conversations))
    plain = spark.createDataFrame([(1, "User: hello\nthere\n\nAssistant: hi\n\nHuman: bye"), (2, None), (3, " \n")], "conv_id bigint, transcript string")
    got = {r.conv_id: r.rendered for r in chat.format_transcripts(plain, model).collect()}
    assert got == {1: "<|user|>\nhello\nthere\n<|end|>\n<|assistant|>\nhi\n<|end|>\n<|user|>\nbye\n<|end|>\n", 2: "", 3: ""}


def test_turns_keep_their_lines(spark):
    bodies = ["What is it?\nContext: a sum\n# Question\n\n\n  of two", "It is\nAnswer: 42\n \nas shown", "Thanks"]
    rows = [(c, t, ("user", "assistant", "user")[t], bodies[t]) for c in range(40) for t in range(3)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.chat_formatting(table).collect()
    # blank lines before marked turns and after marker lines are not the turn's
    whole = chat.render([("user", bodies[0]), ("assistant", bodies[1]), ("user", bodies[2])])
    assert sum(r.n_agreed == 3 for r in got) >= 20 and all((r.rendered == whole) == (r.n_agreed == 3) for r in got)


def test_long_conversations_are_parsed_whole(spark):
    # border turns in all marker styles, marked and not; a gap of a part's length; a last line that the next part may continue
    texts = ["And", "words\nmore", "x", "Answer: 42", "well\n\n- one\n- two"]
    rows = [(c if c else None, t + (64 if t > 140 else 0), ("user", "assistant")[(t + t // 7) % 2], texts[(t * 7 + c) % 5]) for c in range(30) for t in range(200)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts = chat.transcripts(table)
    models = chat.fit(parts)
    turns, got, folds = {}, {}, {}
    for r in sorted(parts.collect(), key=lambda r: r.part):
        turns.setdefault(r.conv_id, []).extend(r.turns)
        folds[r.conv_id] = r.fold
    for r in sorted(chat.chat_formatting(table).collect(), key=lambda r: r.part):
        got[r.conv_id] = got.get(r.conv_id, "") + r.rendered
    assert len(got) == 30 and all(len(t) == 200 for t in turns.values())
    assert len(set(folds.values())) == chat.FOLDS
    assert got == {c: chat.render(models[folds[c]].turns(chat._write(t)[0])) for c, t in turns.items()}


def plain_model(transcripts):
    """Smoothed counts of (written text, [(role, lines)]): a probability for each start, step and feature."""
    start, step, shown = Counter(), Counter(), Counter()
    for text, turns in transcripts:
        states = [(role, i > 0) for role, n in turns for i in range(n)]
        lines = [f for f, _ in chat.read_transcript(text)]
        for i, (state, features) in enumerate(zip(states, lines, strict=True)):
            if i:
                step[states[i - 1], state] += 1
            else:
                start[state] += 1
            for feature in features:
                shown[state, feature] += 1
    return start, step, shown


def share(counts, many, key, group):
    return math.log((counts[key] + 0.1) / (sum(n for k, n in counts.items() if group(k)) + 0.1 * many))


def test_whole_query_matches_a_plain_parser(spark, conversations):
    """The registered query again, by dictionaries and a Viterbi of its own, each fold with the counts of the others."""
    table = conversations.where("conv_id < 60")
    rows = {r.conv_id: r for r in chat.transcripts(table).collect()}
    written = {c: (chat._write(r.turns)[0], [(t.role, len([x for x in chat._write([t])[0].split("\n") if x.strip()])) for t in r.turns if (t.text or "").strip()]) for c, r in rows.items()}
    want = {}
    for fold in range(chat.FOLDS):
        start, step, shown = plain_model([w for c, w in written.items() if rows[c].fold != fold])

        def emit(state, features):
            return sum(share(shown, chat.VALUES[f[0]], (state, f), lambda k: k[0] == state and k[1][0] == f[0]) for f in features)  # noqa: B023

        seen = {}
        steps = {(a, b): share(step, len(chat.STATES), (a, b), lambda k: k[0] == a) for a in chat.STATES for b in chat.STATES}  # noqa: B023
        for c, (text, _) in written.items():
            if rows[c].fold != fold:
                continue
            lines, best = chat.read_transcript(text), {}
            for i, (features, _) in enumerate(lines):
                for s in chat.STATES:
                    if (s, features) not in seen:
                        seen[s, features] = emit(s, features)
                best = {s: max(((v + steps[p, s] + seen[s, features], [*path, s]) for p, (v, path) in best.items()), key=lambda x: x[0]) if i else (share(start, len(chat.STATES), s, lambda k: True) + seen[s, features], [s]) for s in chat.STATES}
            path = max(best.values(), key=lambda x: x[0])[1] if best else []
            turns = []
            for state, (_, line) in zip(path, lines):
                if state[1] and turns and turns[-1][0] == state[0]:
                    turns[-1][1].append(line)
                else:
                    turns.append((state[0], [chat.opening(state[0], line)]))
            want[c] = "".join(f"<|{role}|>\n{chat.BEFORE.sub('', chr(10).join(body)).rstrip()}\n<|end|>\n" for role, body in turns)
    got = {r.conv_id: r.rendered for r in chat.chat_formatting(table).collect()}
    assert len(want) > 20 and got == want


def test_viterbi_finds_the_best_path(conversations):
    from itertools import product

    model, *_ = chat.fit(chat.transcripts(conversations))
    lines = chat.read_transcript("User: a\n\nsome words\nmore\n\nAI: x")
    def score(path):
        out = model.start[path[0]] + model.emission(lines[0][0])[path[0]]
        return out + sum(model.step[a][b] + model.emission(line[0])[b] for a, b, line in zip(path, path[1:], lines[1:]))
    best = max(product(range(len(chat.STATES)), repeat=len(lines)), key=score)
    assert score(model.best_path(lines)) == pytest.approx(score(best))


def test_chat_hostile_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (1, None, "odd", "b"), (None, 0, "user", ""), (2, 200, "assistant", "late"), (2, 1, "user", "x" * 50000)]
    table = spark.createDataFrame([(*r, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    got = {(r.conv_id, r.part): r.n_turns for r in chat.chat_formatting(table).collect()}
    assert got == {(1, 0): 2, (None, 0): 0, (2, 3): 1, (2, 0): 1}
    assert chat.chat_formatting(table.limit(0)).count() == 0
