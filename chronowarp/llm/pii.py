"""Personal data by candidate gradient boosting, with DataFrame functions only.

Base spans follow fixed formats: e-mail addresses, IP addresses, card numbers passing Luhn's test, phone numbers with a
plus sign.  They always stay.  High-recall generators propose candidates of each kind from every place where one may
begin, some with several ends, so that they overlap: written-out, spaced and masked addresses, numbers that a base
pattern has swallowed with what stands beside them, phone numbers without a plus sign.  Boosted trees of each kind judge
a candidate by features of its format and of the text before and after it.  Those at or above the kind's threshold,
calibrated for precision, are added where they meet no base span; of overlapping ones the best by its margin stays.

The trees are fitted on two sources: candidates in a bounded sample of distinct texts (``SAMPLE_DOCS``, ``SAMPLE_CHARS``),
labelled by the base spans they equal, cut or fail to be, and lines that this module generates, whose spans are known.
Half of either chooses the thresholds.  Trees are then written out as SQL expressions, so that the main path has no
Python in it.

Patterns are scanned once each for their matches and for the text between them; running sums of both lengths give
offsets in code points.  Running sums and sweeps go through chunks of ``CHUNK`` items, so that their work grows in
proportion to the matches.  Quantifiers are possessive or bounded, and starts are tied to the start of a run: no text
makes a scan quadratic or deep.

Defined results: null and empty texts have no spans; equal spans of two kinds are both listed; repeated rows are
searched each; an empty table gives no rows; columns of any name pass through, those named like outputs are replaced.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
OUTPUTS = ("base_spans", "spans")
_NAME = "[A-Za-z0-9._%+-]"
#: Fixed formats.
BASE = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a scan to be worth while; every text with a valid match passes.
HINT = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Separators, as written or masked.
_AT, _DOT = r"(?:@|\(at\)|\[at\]|\{at\})", r"(?:\.|\[\.\]|\(dot\)|\[dot\]|\{dot\})"
_HOST = "[A-Za-z0-9-]{1,63}"
_NUMBER = r"(?:\+|00)[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,4})"
_LOCAL = r"\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5})"
_FREE, _END = "(?<![0-9A-Za-z+.])", "(?![0-9A-Za-z])"
#: (kind, what stands before a candidate, the candidate, how much of it is passed over to look for the next, hint).
GENERATORS = (
    ("email", rf"(?<!{_NAME})", rf"{_NAME}{{1,64}}+{_AT}{_HOST}(?:{_DOT}{_HOST}){{1,8}}", rf"{_NAME}++", "(?i)@|[\\[({]at[\\])}]"),
    ("email", rf"(?<!{_NAME})", rf"{_NAME}{{1,64}}+\x20?{_AT}\x20?{_HOST}(?:\x20?{_DOT}\x20?{_HOST}){{1,8}}", rf"{_NAME}++", "(?i)@\x20|\x20@|[\\[({]at[\\])}]|[\\[({]dot[\\])}]"),
    ("ip", "(?<![0-9])", rf"[0-9]{{1,3}}(?:\x20?{_DOT}\x20?[0-9]{{1,3}}){{3}}(?![0-9])", "[0-9]++", rf"[0-9](?:\x20?{_DOT}\x20?[0-9]{{1,3}}){{3}}"),
    ("card", "(?<![0-9])", r"[0-9]{4}(?:[\x20.-]{0,2}[0-9]{4}){2}[\x20.-]{0,2}[0-9]{1,7}(?![0-9])", "[0-9]++", r"[0-9]{4}(?:[\x20.-]{0,2}[0-9]{4}){2}"),
    ("card", "(?<![0-9])", r"[0-9]{4}[\x20.-]{0,2}[0-9]{6}[\x20.-]{0,2}[0-9]{5}(?![0-9])", "[0-9]++", r"[0-9]{4}[\x20.-]{0,2}[0-9]{6}[\x20.-]{0,2}[0-9]{5}(?![0-9])"),
    ("phone", "(?<![0-9A-Za-z+])", rf"{_NUMBER}{{1,2}}(?![0-9])", r"(?:\+|00)[0-9]++", r"(?:\+|00)[0-9]"),
    ("phone", "(?<![0-9A-Za-z+])", rf"{_NUMBER}{{3,4}}(?![0-9])", r"(?:\+|00)[0-9]++", r"(?:\+|00)[0-9]"),
    ("phone", _FREE, rf"{_LOCAL}{{1,2}}{_END}", r"\(?[0-9]++", r"[0-9]\)?[\x20./-]{1,2}[0-9]{2}"),
    ("phone", _FREE, rf"{_LOCAL}{{3,5}}{_END}", r"\(?[0-9]++", r"[0-9]\)?(?:[\x20./-]{1,2}[0-9]{2,5}){2}"),
)
#: Texts without this have no candidates.
ANY_HINT = r"[0-9@]|[\[({][Aa][Tt][\])}]"
SPAN = "struct<start:int,kind:int,end:int,hit:string>"
CANDIDATE = "struct<start:int,kind:int,end:int,hit:string,before:string,after:string>"
CONTEXT_CHARS, CHUNK = 24, 32
ROUNDS, RATE, PRECISION = 30, 0.4, 0.99
#: Documents that trees are fitted on, at most, the longest text taken for it, and candidates.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_CANDIDATES = 1000, 20_000, 20_000
#: Rows drawn by a hash of the text for each document of the sample, so that what one task sorts does not grow with the
#: table. Equal texts count once.
SAMPLE_DRAW = 64
_FAR = 2**31 - 1


def _let(values: dict[str, Column], body) -> Column:
    """``body`` over ``values`` worked out once."""
    packed = F.array(F.struct(*(v.alias(k) for k, v in values.items())))
    return F.get(F.transform(packed, lambda s: body(**{k: s[k] for k in values})), F.lit(0))


def _chunked(items: Column) -> Column:
    """Consecutive slices of ``CHUNK`` items."""
    n = F.size(items)
    places = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda c: F.slice(items, c * CHUNK + 1, CHUNK))


def _swept(items: Column, zero: Column, step, kind: str, state: str = "int") -> Column:
    """What ``step`` (state, item) gives out, (state, array<kind>), item by item. An accumulator is copied at every
    step, so that one pass finds the state before each chunk and another grows arrays within chunks only."""
    none, no_states = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<{state}>")

    def chunk(s: Column, xs: Column) -> Column:
        after = F.aggregate(xs, s["state"], lambda now, x: step(now, x)[0])
        return F.struct(after.alias("state"), F.concat(s["starts"], F.array(s["state"])).alias("starts"))

    def one(s: Column, x: Column) -> Column:
        now, out = step(s["state"], x)
        return F.struct(now.alias("state"), F.concat(s["out"], out).alias("out"))

    def given(chunks: Column, starts: Column) -> Column:
        return F.flatten(F.transform(chunks, lambda xs, i: F.aggregate(xs, F.struct(F.get(starts, i).alias("state"), none.alias("out")), one, lambda s: s["out"])))

    def whole(chunks: Column) -> Column:
        starts = F.aggregate(chunks, F.struct(zero.alias("state"), no_states.alias("starts")), chunk, lambda s: s["starts"])
        return _let({"chunks": chunks, "starts": starts}, given)

    return _let({"items": items}, lambda items: _let({"chunks": _chunked(items)}, whole))


def _matches(text: Column, pattern: str) -> dict[str, Column]:
    """The matches and the pieces between them."""
    return {"hits": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "gaps": F.split(text, pattern, -1)}


def _spans(text: Column, kind: str) -> Column:
    """Matches of a base pattern as spans in order."""
    number = KINDS.index(kind)

    def add(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return end, F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["hit"].alias("hit")))

    def placed(hits: Column, gaps: Column) -> Column:
        steps = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        return F.when(F.size(hits) > 0, _swept(steps, F.lit(0), add, SPAN))

    return F.coalesce(F.when(text.rlike(HINT[kind]), _let(_matches(text, BASE[kind]), placed)), F.array().cast(f"array<{SPAN}>"))


def _proposed(text: Column, generator: tuple[str, str, str, str, str]) -> Column:
    """Candidates of one generator: at every start the body, ahead of what is passed over."""
    kind, free, body, passed, hint = generator
    pattern = rf"{free}(?=({body})((?s:.{{0,4}}))){passed}"
    number = KINDS.index(kind)
    parts = {f"part{i}": F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2)}

    def add(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        fields = {"start": start, "kind": F.lit(number), "end": start + F.length(x["body"]), "hit": x["body"], "before": x["before"], "after": x["after"]}
        return start + F.length(x["hit"]), F.array(F.struct(*(v.alias(k) for k, v in fields.items())))

    def placed(hits: Column, gaps: Column, part1: Column, part2: Column) -> Column:
        def item(h: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            before = F.substring(F.concat(F.when(i > 0, F.get(hits, i - 1)).otherwise(""), gap), -CONTEXT_CHARS, CONTEXT_CHARS)
            return F.struct(h.alias("hit"), gap.alias("gap"), F.get(part1, i).alias("body"), F.get(part2, i).alias("after"), before.alias("before"))

        return F.when(F.size(hits) > 0, _swept(F.transform(hits, item), F.lit(0), add, CANDIDATE))

    return F.coalesce(F.when(text.rlike(hint), _let(_matches(text, pattern) | parts, placed)), F.array().cast(f"array<{CANDIDATE}>"))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    d = F.reverse(_digits(hit))
    value = lambda i: F.substring(d, i, 1).cast("int")
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return F.length(d).between(12, 19) & (F.when(F.length(d).between(12, 19), total % 10) == 0)


def _valid(kind: str, hit: Column, loose: bool = False) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        parts = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0)) if loose else F.split(hit, r"\.")
        return F.forall(parts, lambda p: (F.length(part(p)) <= 3) & (F.when(F.length(part(p)) <= 3, part(p)).cast("int") <= 255))
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(7 if loose else 9, 15)
    return hit.rlike("[A-Za-z]{2,}$") if loose else F.lit(True)


def counted(spans: str, kind: int) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


FEATURES = ("valid", "length", "digits", "groups", "letters", "dots", "dashes", "slashes", "parens", "spaces", "plus", "masked", "first_group", "last_group", "even_groups", "year", "cut_before", "cut_after", "says_phone", "says_mail", "says_card", "says_other")


def _features(c: Column) -> Column:
    """A candidate's kind and features as a struct of ints."""
    hit, before, after = c["hit"], c["before"], c["after"]
    count = lambda p: F.regexp_count(hit, F.lit(p))
    says = lambda words: before.rlike(rf"(?i)(?:{words})[^A-Za-z]{{0,6}}$")
    groups = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
    valid = F.lit(False)
    for i, kind in enumerate(KINDS):
        valid = F.when(c["kind"] == i, _valid(kind, hit, True)).otherwise(valid)
    first = F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0))
    values = {
        "valid": valid,
        "length": F.length(hit),
        "digits": F.length(_digits(hit)),
        "groups": F.size(groups),
        "letters": count("[A-Za-z]"),
        "dots": count(r"\."),
        "dashes": count("-"),
        "slashes": count("/"),
        "parens": count(r"\("),
        "spaces": count(" "),
        "plus": hit.rlike(r"^(?:\+|00)"),
        "masked": hit.rlike(r"(?i)[\[({](?:at|dot|\.)[\])}]"),
        "first_group": first,
        "last_group": F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0)),
        "even_groups": F.forall(groups, lambda g: F.length(g) == first),
        "year": hit.rlike("(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"),
        "cut_before": before.rlike(r"[0-9+][\x20().,/-]{0,2}$").cast("int") + before.rlike(r"[0-9+][().,/-]{0,2}$").cast("int"),
        "cut_after": after.rlike(r"^[\x20().,/-]{0,2}[0-9]").cast("int") + after.rlike(r"^(?:[().,/-]{0,2}[0-9]|[A-Za-z@_])").cast("int"),
        "says_phone": says("phone|tel|telephone|mobile|cell|call|fax|telefon|teléfono|téléphone|contact"),
        "says_mail": says("mail|e-mail|email|contact|write to|at|me"),
        "says_card": says("card|visa|mastercard|amex|credit|karte|tarjeta|carte"),
        "says_other": says("order|version|invoice|isbn|id|no|number|ref|date|on|page|pages|price|model|serial|part"),
    }
    return F.struct(c["kind"].alias("kind"), *(values[n].cast("int").alias(n) for n in FEATURES))


def _training_lines(seed: int = 5, each: int = 12) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines with known spans (kind, start, end): personal data in many forms, alone and beside other numbers, and what
    looks like it."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pick = rng.choice

    def card(form: str) -> str:
        n = form.count("#") - 1
        head = pick("3456") + d(n - 1)
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(head))))
        number = iter(head + str(-total % 10))
        return "".join(next(number) if c == "#" else c for c in form)

    filled = lambda form: "".join(d(1) if c == "#" else c for c in form)
    name = lambda: pick(["anna", "j.doe", "max99", "sales", "info.desk", "li_wei", "m-kurz"])
    host = lambda: pick(["example", "mail7.test", "uni-x", "corp"])
    end = lambda: pick(["com", "org", "net", "de"])
    part = lambda: str(rng.randrange(1, 256))
    good = {
        0: [lambda: f"{name()}@{host()}.{end()}", lambda: f"{name()} (at) {host()} (dot) {end()}", lambda: f"{name()}[at]{host()}.{end()}", lambda: f"{name()}(at){host()}[dot]{end()}", lambda: f"{name()} @ {host()}.{end()}"],
        1: [lambda: ".".join(part() for _ in range(4)), lambda: "[.]".join(part() for _ in range(4)), lambda: "[dot]".join(part() for _ in range(4))],
        2: [lambda: card("####-####-####-####"), lambda: card("#### #### #### ####"), lambda: card("################"), lambda: card("####.####.####.####"), lambda: card("#### ###### #####")],
        3: [lambda: filled("+1 (###) ###-####"), lambda: filled("+49 30 #######"), lambda: filled("+44 20 #### ####"), lambda: filled("0033 1 ## ## ## ##"), lambda: filled("(###) ###-####"), lambda: filled("###-###-####"), lambda: filled("0###/#### ###"), lambda: filled("0# ## ## ## ##")],
    }
    says = {0: ["mail ", "to ", "e-mail: ", ""], 1: ["host ", "from ", "ip ", ""], 2: ["card ", "visa ", "no. ", ""], 3: ["phone ", "tel: ", "call ", "mobile ", "fax ", "telefon ", ""]}
    bad = [
        *(lambda f=f: filled(f) for f in ("19##-0#-1#", "1#.0#.20##", "##/##/20##", "## ## ##", "##.##.###", "978-##-####-###-##", "##### ##### ##### #####", "##-#####-##", "### ###", "########", "#.#.##", "## ###")),
        lambda: filled("3") + "00.4" + d(2) + ".12." + d(2),
        lambda: f"looking (at) page {d(2)}. then",
        lambda: f"x[at] {d(1)} .{d(1)}",
    ]
    lines: list[tuple[str, list[tuple[int, int, int]]]] = []

    def line(*parts: tuple[int, str] | str) -> None:
        text, spans = "", []
        for x in parts:
            if isinstance(x, str):
                text += x
            else:
                spans.append((x[0], len(text), len(text) + len(x[1])))
                text += x[1]
        lines.append((text, spans))

    for _ in range(each):
        for kind, forms in good.items():
            for form in forms:
                line("please ", pick(says[kind]), (kind, form()), pick([" today", ", thanks", ".", ""]))
        for form in bad:
            line("see ", pick(["order ", "version ", "invoice no ", "isbn ", "id ", "ref ", "on ", "pages ", "the ", ""]), form(), " there")
        for left in (0, 1, 2, 3):  # side by side, so that a base pattern may take both for one
            for right in (1, 2, 3):
                line("", (left, good[left][0]()), " ", (right, good[right][pick((0, 0, 1, 2))]()), " end")
        line("on 2023 ", (2, good[2][pick((0, 1, 2))]()), " end")
        line("", (2, good[2][2]()), " ", (2, good[2][2]()), " end")
        line("", (3, good[3][0]()), " ", filled(pick(["################", "#####", "###.##.###"])), " end")
    return lines


Tree = tuple[int, int, tuple[int, int], tuple[int, int], tuple[float, float, float, float]]


def _boost(x: np.ndarray, y: np.ndarray) -> list[Tree]:
    """Trees of depth two by second-order boosting of the logistic loss; cuts are of the form feature <= value."""
    if not len(y):
        return []
    rows, code = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
    weight = np.bincount(code.ravel(), minlength=len(rows)) ** 0.5  # much repeated rows count for less
    x, y = rows[:, :-1], rows[:, -1]

    def cut(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best, found = -1.0, (0, 0)
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f]):
                left = x[rows, f] <= v
                gl, hl, gr, hr = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
                gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
                if gain > best + 1e-12:
                    best, found = gain, (f, int(v))
        return found

    odds, trees = np.zeros(len(y)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-odds))
        g, h = weight * (y - p), weight * p * (1 - p)
        everything = np.arange(len(y))
        f, v = cut(everything, g, h)
        sides = [everything[x[:, f] <= v], everything[x[:, f] > v]]
        cuts = [cut(s, g, h) if len(s) else (0, 0) for s in sides]
        leaves = []
        for s, (f2, v2) in zip(sides, cuts, strict=True):
            for part in (s[x[s, f2] <= v2], s[x[s, f2] > v2]):
                value = RATE * g[part].sum() / (h[part].sum() + 1)
                odds[part] += value
                leaves.append(round(float(value), 6))
        trees.append((f, v, cuts[0], cuts[1], tuple(leaves)))
    return trees


def _apply(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for f, v, (f1, v1), (f2, v2), (a, b, c, d) in trees:
        out += np.where(x[:, f] <= v, np.where(x[:, f1] <= v1, a, b), np.where(x[:, f2] <= v2, c, d))
    return out


class Model:
    """For each kind boosted trees and the log odds from which a candidate is taken."""

    def __init__(self, trees: list[list[Tree]], thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    def margins(self, features: str) -> Column:
        """Log odds less the kind's threshold of each of an array of features, as one parsed expression."""

        def tree(t: Tree) -> str:
            f, v, (f1, v1), (f2, v2), (a, b, c, d) = t
            pick = lambda f, v, a, b: f"case when x.{FEATURES[f]} <= {v} then {a} else {b} end"
            return pick(f, v, pick(f1, v1, f"{a}D", f"{b}D"), pick(f2, v2, f"{c}D", f"{d}D"))

        cases = "".join(f" when x.kind = {i} then {-self.thresholds[i]}D + " + " + ".join(map(tree, t)) for i, t in enumerate(self.trees) if t and self.thresholds[i] < float("inf"))
        return F.expr(f"transform({features}, x -> case{cases} else -1D end)") if cases else F.transform(features, lambda _: F.lit(-1.0))


def _base(text: Column) -> Column:
    """Valid base spans in order."""
    checked = lambda kind: lambda span: _valid(kind, span["hit"])
    return F.array_sort(F.concat(*(F.filter(_spans(text, k), checked(k)) for k in KINDS)))


def _candidates(text: Column) -> Column:
    return F.array_sort(F.concat(*(_proposed(text, g) for g in GENERATORS)))


def _labelled(docs: DataFrame, text_col: str) -> DataFrame:
    """(part, kind, y, features) of candidates, and which half their text is in. In a bounded sample of ``docs`` y is 1
    for one equal to a base span, 0 if it cuts or joins one or has not its kind's format; others are left out. In
    generated lines y tells whether it is a known span."""
    text = F.col(text_col)
    share = min(1.0, SAMPLE_DRAW * SAMPLE_DOCS / max(docs.count(), 1))
    drawn = F.pmod(F.xxhash64(text), F.lit(2**31)) < int(share * 2**31)
    few = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).where(drawn & (F.length(text) <= SAMPLE_CHARS) & text.rlike(ANY_HINT))
    few = few.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(SAMPLE_DOCS)
    few = few.select(F.pmod("h", F.lit(2)).cast("int").alias("part"), F.lit(None).cast("array<string>").alias("known"), "text")
    lines = [f"{i % 2}\t" + ";".join(":".join(map(str, s)) for s in spans) + f"\t{text}" for i, (text, spans) in enumerate(_training_lines())]
    rows = docs.sparkSession.range(1).select(F.explode(F.split(F.lit("\n".join(lines)), "\n")).alias("line")).select(F.split("line", "\t").alias("p"))
    rows = few.union(rows.select(F.col("p")[0].cast("int").alias("part"), F.split(F.col("p")[1], ";").alias("known"), F.col("p")[2].alias("text")))
    rows = rows.withColumn("base", _base(F.col("text"))).withColumn("c", F.explode(_candidates(F.col("text"))))
    right = F.array_contains("known", F.concat_ws(":", "c.kind", "c.start", "c.end"))
    same = F.exists("base", lambda b: (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end")) & (b["kind"] == F.col("c.kind")))
    meets = F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (F.col("c.start") < b["end"]))
    rows = rows.select("part", F.col("c.kind").alias("kind"), "known", right.alias("right"), same.alias("same"), meets.alias("meets"), _features(F.col("c")).alias("f"))
    y = F.when(F.col("known").isNotNull(), F.col("right").cast("int")).when(F.col("same"), 1).when(F.col("meets") | (F.col("f.valid") == 0), 0)
    return rows.withColumn("y", y).where("y is not null").select("part", "kind", "y", *(f"f.{n}" for n in FEATURES)).limit(SAMPLE_CANDIDATES)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Fit on a bounded sample of ``docs`` and on the generated lines; half of either chooses the thresholds."""
    found = _labelled(docs, text_col).collect()  # bounded by the sample
    rows = np.array(sorted(found)).reshape(len(found), 3 + len(FEATURES))
    trees, thresholds = [], []
    for kind in range(len(KINDS)):
        part, y, x = (rows[rows[:, 1] == kind][:, c] for c in (0, 2, slice(3, None)))
        trees.append(_boost(x[part == 0], y[part == 0]))
        odds, truth = _apply(trees[-1], x[part == 1]), y[part == 1]
        order = np.argsort(-odds, kind="stable")
        odds, truth = odds[order], truth[order]
        precision = np.cumsum(truth) / np.arange(1, len(truth) + 1)
        last = np.r_[odds[1:] < odds[:-1], True] if len(odds) else np.zeros(0, dtype=bool)  # equal ones go together
        good = np.flatnonzero((precision >= PRECISION) & last)
        thresholds.append(max(float(odds[good[-1]]), 0.0) if len(good) else float("inf"))
    return Model(trees, thresholds)


_SWEPT = "struct<start:int,rank:int,c:" + CANDIDATE + ">"


def _free(base: Column, candidates: Column) -> Column:
    """The candidates that meet no base span, in order."""
    blank = [F.lit("").alias(n) for n in ("hit", "before", "after")]
    mark = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("rank"), F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), *blank).alias("c")))
    both = F.array_sort(F.concat(mark, F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("rank"), c.alias("c")))))
    none = F.array().cast(f"array<{_SWEPT}>")

    def past(reach: Column, x: Column) -> tuple[Column, Column]:
        is_base = x["rank"] == 0
        return F.when(is_base, F.greatest(reach, x["c"]["end"])).otherwise(reach), F.when(is_base | (x["start"] >= reach), F.array(x)).otherwise(none)

    def ahead(next_base: Column, x: Column) -> tuple[Column, Column]:
        is_base = x["rank"] == 0
        return F.when(is_base, x["start"]).otherwise(next_base), F.when(~is_base & (x["c"]["end"] <= next_base), F.array(x)).otherwise(none)

    after = F.reverse(_swept(both, F.lit(0), past, _SWEPT))
    return F.transform(F.reverse(_swept(after, F.lit(_FAR), ahead, _SWEPT)), lambda x: x["c"])


_SCORED = "struct<margin:double,start:int,kind:int,end:int,hit:string>"


def _best(scored: Column) -> Column:
    """Of overlapping candidates, in order, the one with the best margin (the longer, the earlier of equal ones)."""
    sentinel = F.struct(F.lit(0.0).alias("margin"), F.lit(_FAR).alias("start"), F.lit(0).alias("kind"), F.lit(_FAR).alias("end"), F.lit("").alias("hit"))
    start = F.struct(F.lit(-1.0).alias("margin"), F.lit(-1).alias("start"), F.lit(0).alias("kind"), F.lit(0).alias("end"), F.lit("").alias("hit"))

    def step(held: Column, x: Column) -> tuple[Column, Column]:
        apart = x["start"] >= held["end"]
        better = (x["margin"] > held["margin"]) | ((x["margin"] == held["margin"]) & (x["end"] - x["start"] > held["end"] - held["start"]))
        return F.when(apart | better, x).otherwise(held), F.when(apart & (held["start"] >= 0), F.array(held)).otherwise(F.array().cast(f"array<{_SCORED}>"))

    return _swept(F.concat(scored, F.array(sentinel)), start, step, _SCORED, _SCORED)


def find(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (all): arrays of start, kind (index in KINDS), end, hit, in order."""
    model = model or fit(docs, text_col)
    docs = docs.drop(*OUTPUTS)
    df = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(text_col, F.lit("")).alias("text"))
    df = df.select("row", _base(F.col("text")).alias("base_spans"), F.when(F.col("text").rlike(ANY_HINT), _candidates(F.col("text"))).alias("candidates"))

    df = df.withColumn("free", F.when(F.size("candidates") > 0, _free(F.col("base_spans"), F.col("candidates"))))
    df = df.withColumn("features", F.transform("free", _features))
    df = df.withColumn("margins", model.margins("features"))
    scored = F.zip_with("free", "margins", lambda c, m: F.struct(m.alias("margin"), *(c[n].alias(n) for n in ("start", "kind", "end", "hit"))))
    good = F.filter(scored, lambda s: s["margin"] >= 0)

    def added(good: Column) -> Column:
        return F.transform(_best(good), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["hit"].alias("hit")))

    more = _let({"good": good}, lambda good: F.when(F.size(good) > 0, F.array_sort(F.concat(F.col("base_spans"), added(good)))))
    df = df.select("row", "base_spans", F.coalesce(more, "base_spans").alias("spans"))
    return df.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), "base_spans", "spans")


def listed(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


_PLACE = "struct<start:int,kind:int,end:int>"


def _merged(spans: Column) -> Column:
    """Overlapping spans as one, of the first one's kind."""
    sentinel = F.struct(F.lit(_FAR).alias("start"), F.lit(0).alias("kind"), F.lit(_FAR).alias("end"))
    start = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("kind"), F.lit(0).alias("end"))

    def step(held: Column, x: Column) -> tuple[Column, Column]:
        apart = x["start"] >= held["end"]
        longer = F.struct(held["start"].alias("start"), held["kind"].alias("kind"), F.greatest(held["end"], x["end"]).alias("end"))
        return F.when(apart, x).otherwise(longer), F.when(apart & (held["start"] >= 0), F.array(held)).otherwise(F.array().cast(f"array<{_PLACE}>"))

    places = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return _swept(F.concat(places, F.array(sentinel)), start, step, _PLACE, _PLACE)


def _replaced(text: Column, places: Column) -> Column:
    """``text`` with every place replaced by its kind. The text is cut once for each chunk of places, not for each."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def whole(places: Column) -> Column:
        cuts = F.transform(places, lambda x, i: F.struct(F.when(i > 0, F.get(places, i - 1)["end"]).otherwise(0).alias("from"), x["start"].alias("to"), F.get(names, x["kind"]).alias("name")))

        def chunk(xs: Column) -> Column:
            begin, end = F.get(xs, F.lit(0))["from"], F.element_at(xs, -1)["to"]
            return _let({"piece": text.substr(begin + 1, end - begin), "begin": begin, "xs": xs}, lambda piece, begin, xs: F.array_join(F.transform(xs, lambda x: F.concat(piece.substr(x["from"] - begin + 1, x["to"] - x["from"]), x["name"])), ""))

        last = F.element_at(places, -1)["end"]
        return F.concat(F.array_join(_let({"cuts": cuts}, lambda cuts: F.transform(_chunked(cuts), chunk)), ""), text.substr(last + 1, F.length(text)))

    return _let({"places": places}, whole)


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` (same columns) with every span replaced by its kind in brackets; overlapping spans become one, named
    after the first. Null texts stay null."""
    found = find(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text")), model, "text")
    text = F.col("text")
    changed = F.when(F.size("spans") > 0, _replaced(text, _merged(F.col("spans")))).otherwise(text)
    return found.select(*(changed.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
