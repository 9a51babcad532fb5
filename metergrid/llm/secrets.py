"""Secret scan with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query in disjunctive form: a text can match only if,
for one of the clauses, it holds all trigrams of the clause. The scan

1. builds the postings (trigram, document) of every trigram that a query names, from lower-cased texts;
2. intersects the postings of each clause, which leaves a document's candidate rules;
3. verifies candidates with the regular expression and computes the spans of its matches.

A rule whose expression has no mandatory trigram is run on every text.
"""

from __future__ import annotations

import re
import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _either(word: str) -> str:
    """A pattern for the letters of word in either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: a match counts if this group has as many characters at least
    group: int = 0
    least: int = 1


def _pem() -> str:
    """A private key from its first line to its last one. Where that is missing, to the end of its base64: lines
    without anything else, then 124 pieces of 32 characters at least, as long as a key of 60,000 bits, behind blanks,
    quotes or signs of comments. The first word after them may go with the key.

    Java repeats a group by recursion and RE2 at most 1,000 times, hence bounds on groups; sets have none."""
    label, base = "[A-Z ]*PRIVATE KEY-----", "[A-Za-z0-9+/=]"
    whole = rf"[^-]*(?:--?-?-?[^-]+){{0,400}}------*END {label}"
    piece = rf"""(?:[\s"'>#*+,;\\-]+{base}{{32,}}){{0,31}}"""
    return rf"""-----BEGIN {label}(?:{whole}|[\\\r\nA-Za-z0-9+/=]*{piece * 4}(?:[ \t"'>#*+,;\\]*[\r\n]+[ \t"'>#*]*{base}+)?)"""


# The three base kinds, then public formats of keys and tokens.
RULES = (
    Rule("assign", "(" + "|".join(_either(x) for x in ("password", "passwd", "secret", "token")) + f"|{_either('api')}_?{_either('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
    Rule("pem", _pem()),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("mapkey", "AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", "[rs]k_live_[A-Za-z0-9]{16,}"),
)
BASE = ("assign", "access", "hex")

#: Strings that one literal stretch of an expression may stand for before it is cut.
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The clauses of a regular expression's trigram query over lower-cased text; None if it has no mandatory
    trigram. A clause that holds another one is left out."""
    clauses = _sequence(parser.parse(pattern))[1]
    if clauses is None:
        return None
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    return {x | y for x in a for y in b}


def _grams(strings):
    if any(len(s) < 3 for s in strings):
        return None
    return {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}


def _sequence(items):
    """(all strings that the items stand for, or None where they are too many; clauses, or None for no demand)."""
    run, query, exact = {""}, None, True
    for op, value in items:
        strings, inner = _node(op, value)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query, exact = _both(query, _grams(run)), False
        query = _both(query, inner if strings is None else _grams(strings))
        run = {""} if strings is None or len(strings) > MOST_STRINGS else strings
    return (run, _grams(run)) if exact else (None, _both(query, _grams(run)))


def _node(op, value):
    if op is kinds.LITERAL:
        return {chr(value).lower()}, None
    if op is kinds.IN:
        chars = set()
        for kind, x in value:
            if kind is kinds.LITERAL:
                chars.add(chr(x).lower())
            elif kind is kinds.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is kinds.SUBPATTERN:
        return _sequence(value[3])
    if op is kinds.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts):
            strings = set().union(*(s for s, _ in parts))
            return (strings, None) if len(strings) <= MOST_STRINGS else (None, _grams(strings))
        queries = [q if s is None else _grams(s) for s, q in parts]
        return None, None if any(q is None for q in queries) else set().union(*queries)
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        low, high, item = value
        strings, inner = _sequence(item)
        if low == 0:
            return ({""} | strings, None) if high == 1 and strings is not None else (None, None)
        if low == high == 1:
            return strings, inner
        return None, inner if strings is None else _grams(strings)
    return None, None


def postings(docs: DataFrame, grams: list[str], id_col: str, text_col: str) -> DataFrame:
    """(gram, id): the documents that hold each of the trigrams, letters in either case."""
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low")).where("low IS NOT NULL")
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("id", held.alias("grams")).select("id", F.explode("grams").alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(id, rules): for each document the kinds whose trigram query it satisfies."""
    rows, vocabulary = [], set()
    for rule in rules:
        for n, clause in enumerate(trigram_query(rule.pattern) or ()):
            vocabulary |= clause
            rows += [{"gram": g, "kind": rule.kind, "clause": n, "bit": 1 << i, "whole": (1 << len(clause)) - 1} for i, g in enumerate(sorted(clause))]
    # from Arrow: of a list Spark makes an RDD that Python workers read, a second set beside those of other operators
    demands = docs.sparkSession.createDataFrame(pa.Table.from_pylist(rows, pa.schema([("gram", pa.string()), ("kind", pa.string()), ("clause", pa.int32()), ("bit", pa.int64()), ("whole", pa.int64())])))
    return (
        postings(docs, sorted(vocabulary), id_col, text_col)
        .join(F.broadcast(demands), "gram")  # as many rows as the rules have trigrams
        .groupBy("id", "kind", "clause", "whole")
        .agg(F.bit_or("bit").alias("held"))
        .where("held = whole")
        .groupBy("id")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _running(values: Column, join) -> Column:
    """What join (a sum or a maximum) makes of each value with all before it: each pass joins in as many again, so an array
    of n values takes log2(n) passes and nothing is copied for every value."""
    passes = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    width = lambda k: F.pow(F.lit(2), k).cast("int")
    return F.aggregate(passes, values, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= width(k), join(x, F.get(acc, i - width(k)))).otherwise(x)))


def _lengths(rule: Rule, text: Column) -> Column:
    """Lengths of a rule's matches (m), of what it tests of them (v) and of the texts before them (gap, one more)."""
    # Java and Python agree on these expressions
    size = lambda texts: F.transform(texts, lambda x: F.char_length(x))
    matched = size(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    tested = size(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else F.lit(None).cast("array<int>")
    return F.struct(matched.alias("m"), tested.alias("v"), size(F.split(text, rule.pattern, -1)).alias("gap"))


def _spans(rule: Rule, order: int, lengths: Column) -> Column:
    """array<struct<first, place, last, kind>> of a rule's matches."""
    m = lengths["m"]
    last = _running(F.zip_with(F.slice(lengths["gap"], 1, F.size(m)), m, lambda a, b: a + b), lambda a, b: a + b)
    kept = F.filter(F.arrays_zip(last.alias("last"), m.alias("m"), (lengths["v"] if rule.group else m).alias("v")), lambda x: x["v"] >= rule.least)
    return F.transform(kept, lambda x: F.struct((x["last"] - x["m"]).alias("first"), F.lit(order).alias("place"), x["last"].alias("last"), F.lit(rule.kind).alias("kind")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs with secrets: array<struct<first, place, last, kind>>, code points, last exclusive, in order
    of first and then of the rules. Matches of one rule don't overlap (leftmost first); those of different rules may.

    Null and empty texts have none. Rows with the same id are scanned each with the candidates of all of them, so
    the result is right for each row; rows without an id are scanned like any other.
    """
    indexed = [r for r in rules if trigram_query(r.pattern) is not None]
    found = candidates(docs, tuple(indexed), id_col, text_col).select(F.col("id").alias("_candidate"), F.col("kinds").alias("_kinds"))
    rows = docs.drop("secrets")
    joined = rows.join(found, rows[id_col].eqNullSafe(found["_candidate"]), "left")
    text = F.col(text_col)
    none = F.expr("cast(array() as array<struct<first:int,place:int,last:int,kind:string>>)")
    lengths, spans = [], []
    for order, rule in enumerate(rules):
        asked = F.array_contains("_kinds", rule.kind) & text.rlike(rule.pattern) if rule in indexed else text.rlike(rule.pattern)
        # a column of its own, so that each expression runs once
        lengths.append(F.when(asked, _lengths(rule, text)).alias(f"_l{order}"))
        one = F.col(f"_l{order}")
        spans.append(F.when(one.isNotNull(), _spans(rule, order, one)).otherwise(none))
    measured = joined.select(*[rows[c] for c in rows.columns], *lengths)
    return measured.select(*[F.col(f"`{c}`") for c in rows.columns], F.array_sort(F.concat(*spans)).alias("secrets"))


def written_spans(secrets: Column) -> Column:
    """kind:first:last of each span, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")


#: Code points of a piece of a text from which stretches are taken.
PIECE = 1024


def _between(pieces: Column, first: Column, last: Column) -> Column:
    """The code points from first to last of a text that is cut into pieces."""
    whole = lambda n: F.floor(n / PIECE).cast("int")
    a, b = whole(first), whole(last)
    piece = lambda n: F.coalesce(F.get(pieces, n), F.lit(""))
    same = F.substring(piece(a), (first % PIECE + 1).cast("int"), (last - first).cast("int"))
    inner = F.array_join(F.slice(pieces, a + 2, F.greatest(F.lit(0), b - a - 1)), "")
    return F.when(a == b, same).otherwise(F.concat(F.substring(piece(a), (first % PIECE + 1).cast("int"), F.lit(PIECE)), inner, F.substring(piece(b), F.lit(1), (last % PIECE).cast("int"))))


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of find_secrets() with each maximal stretch of secret characters replaced by [secret]."""
    text, secrets = F.col(text_col), F.col("secrets")
    upto = _running(F.transform(secrets, lambda s: s["last"]), F.greatest)
    # a span that begins at the end of all before it or later begins a stretch, and text stands before it
    begins = F.filter(F.transform(secrets, lambda s, i: F.struct(F.when(i > 0, F.get(F.col("_upto"), i - 1)).otherwise(0).alias("at"), s["first"].alias("first"))), lambda x: x["first"] >= x["at"])
    kept = F.transform(begins, lambda x: _between(F.col("_pieces"), x["at"], x["first"]))
    rest = _between(F.col("_pieces"), F.element_at("_upto", -1), F.char_length(text))
    clean = F.when(F.size(secrets) > 0, F.array_join(F.concat(kept, F.array(rest)), "[secret]")).otherwise(text)
    some = F.when(F.size(secrets) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    return found.withColumns({"_upto": upto, "_pieces": some}).withColumn(text_col, clean).drop("_upto", "_pieces")
