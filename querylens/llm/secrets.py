"""Secret scans with DataFrame functions only.

Base rules find assignments, access keys and long hexadecimal strings.  A
pair of character Markov models adds what has no such shape: every run of
``MIN_RUN`` or more characters of the key alphabet is scored by the
log-likelihood ratio of a model of random strings against one of ordinary
identifiers, both first-order and trained from labelled samples.

Positions come from the text itself: each pattern's matches are set off by a
separator, the text is split there, and the lengths of the pieces give the
spans in code points (end exclusive).
"""

from __future__ import annotations

import base64
import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, materialise

#: The base rules and their order.  In ``access`` and ``hex``
#: the least length is part of the pattern: a shorter match ends where its
#: character class ends, so nothing in it could match instead.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1     # 0: start of the run
MIN_RUN = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
THRESHOLD = 24.0               # natural log of the likelihood ratio
SAMPLE_ROWS = 20_000
#: Share of the even distribution in a model's rows: random, ordinary.
EVEN = {True: 0.5, False: 0.01}
MASK = "[secret]"

#: Labelled samples that go with those of the corpus: names and paths as
#: programs write them, and random strings, made by a rule.
IDENTIFIERS = """
    get_user_account_by_id set_default_timeout_seconds max_retry_count_exceeded is_valid_email_address
    customer_order_line_item last_modified_timestamp total_amount_in_cents http_request_handler read_from_buffer
    parse_command_line_args database_connection_pool create_table_if_not_exists user_id first_name order_date
    the_name_of_the_file number_of_rows_in_table this_is_a_test_case quick_sort_in_place find_next_free_block
    getUserAccountInformation setDefaultConnectionTimeout isValidEmailAddress parseCommandLineArguments
    HttpRequestHandlerFactory AbstractSingletonProxyBean createNewDocumentFromTemplate onButtonClickListener
    findElementsByClassName numberOfActiveConnections XMLHttpRequest calculateTotalPriceWithTax ByteArrayOutputStream
    MAX_BUFFER_SIZE DEFAULT_TIMEOUT_SECONDS SOME_CONSTANT_VALUE ENABLE_DEBUG_LOGGING HTTP_STATUS_NOT_FOUND
    /usr/local/share/applications /home/user/projects/website/index /var/log/system/messages /etc/network/interfaces
    src/main/resources/config/application docs/images/screenshots/overview tests/unit/test_string_utils
    2024-01-31 2023-12-05-10-30-00 1999-07-14 version-10-2-1 release-2024-06-30 chapter-12-section-3 page-105
    long-hyphenated-slug-of-a-blog-post how-to-write-a-good-title state-of-the-art well-known-and-widely-used
    ---------------------------------------- ________________________________ ================================
    +----------------+----------------+ //////////////////// 00000000000000000000 12345678901234567890
""".split()
RANDOM_STRINGS = 200


def _random_strings() -> list[str]:
    return [base64.b64encode(hashlib.sha256(f"random {i}".encode()).digest()).decode().rstrip("=") for i in range(RANDOM_STRINGS)]

_SEP, _OTHER = "\u0001", "\u0002"      # neither is in any pattern
_EMPTY = "array<struct<start:int,kind:int,end:int>>"


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut before and after every match: matches at odd places."""
    return F.split(F.regexp_replace(text, pattern, f"{_SEP}$0{_SEP}"), _SEP)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once a row, also where ``body``
    names it inside a function of every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """An array cut into blocks of an even length near the root of its own: work
    inside the blocks and work over the blocks stay far from its square."""
    length = lambda xs: (F.ceil(F.sqrt(F.size(xs)) / 2) * 2).cast("int")

    def cut(xs: Column, n: Column) -> Column:
        at = F.sequence(F.lit(0), F.ceil(F.size(xs) / n).cast("int") - 1)
        return F.when(F.size(xs) > 0, F.transform(at, lambda i: F.slice(xs, i * n + 1, n))).otherwise(F.slice(F.array(xs), 1, 0))

    return _let(items, lambda xs: _let(length(xs), lambda n: cut(xs, n)))


def _spans(pieces: Column, kind: int, accept) -> Column:
    """Accepted matches as spans: places inside a block of pieces first, then
    every block moved by the lengths of those before it."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(_EMPTY).alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p)
        span = F.array(F.struct(a["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        hit = (a["i"] % 2 == 1) & accept(p)        # blocks have even lengths
        return F.struct(end.alias("at"), (a["i"] + 1).alias("i"),
                        F.when(hit, F.concat(a["out"], span)).otherwise(a["out"]).cast(_EMPTY).alias("out"))

    blocks = F.transform(_blocks(pieces), lambda b: F.aggregate(b, start, step))

    def move(a: Column, b: Column) -> Column:
        out = F.transform(b["out"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), s["kind"].alias("kind"),
                                                       (s["end"] + a["at"]).alias("end")))
        return F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(out.cast(_EMPTY))).alias("out"))

    moved = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_EMPTY}>").alias("out")), move,
                        lambda a: F.flatten(a["out"]))
    return F.when(F.size(pieces) > 1, moved).otherwise(F.array().cast(_EMPTY))


def _matches(pieces: Column) -> Column:
    return F.filter(pieces, lambda p, i: i % 2 == 1)


def _states(run: Column) -> Column:
    """Alphabet numbers of a run's characters."""
    return F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _cut(docs: DataFrame, text: str) -> DataFrame:
    t = docs.withColumn("_t", F.translate(as_text(text), _SEP, _OTHER))
    return t.withColumns({"_p0": _pieces(F.col("_t"), ASSIGN), "_p1": _pieces(F.col("_t"), ACCESS), "_p2": _pieces(F.col("_t"), HEX)})


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``_t`` (text without separators, null as
    empty) and ``_base`` (array of start, kind, end, in order)."""
    long_enough = lambda p: F.length(F.regexp_extract(p, ASSIGN, 2)) >= ASSIGN_LEAST
    always = lambda p: F.lit(True)
    base = F.concat(_spans(F.col("_p0"), 0, long_enough), _spans(F.col("_p1"), 1, always), _spans(F.col("_p2"), 2, always))
    return _cut(docs, text).withColumn("_base", F.array_sort(base)).drop("_p0", "_p1", "_p2")


def labelled_samples(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``run, random``: strings labelled random (what the base rules find:
    assigned values, access keys, hexadecimal strings) or ordinary (all other
    runs of the alphabet) in at most ``sample_rows`` documents, those with the
    smallest hash of their id."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows ids: safe to broadcast
    some = _cut(docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(ids), "doc_id"), "text")
    assigned = F.filter(F.transform(_matches(F.col("_p0")), lambda p: F.regexp_extract(p, ASSIGN, 2)), lambda v: F.length(v) >= ASSIGN_LEAST)
    values = F.concat(assigned, _matches(F.col("_p1")), _matches(F.col("_p2")))
    random = some.select(F.explode(values).alias("run"), F.lit(True).alias("random"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("_t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = some.select(F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("run"), F.lit(False).alias("random"))
    return random.union(ordinary)


def train(samples: DataFrame) -> list[float]:
    """Log ratios of the two models' transition probabilities, by
    ``state * STATES + next state``.  ``samples``: ``run`` (null: none) and
    boolean ``random``.  :data:`IDENTIFIERS` and the rule's random strings
    are added with the total weight of the given samples of their label, so
    the models are defined without any.  Every row of a model is mixed with
    the even distribution by a fixed share (:data:`EVEN`), so one rare step
    weighs the same however large the corpus is."""
    states = F.concat(F.array(F.lit(0)), _states(F.coalesce("run", F.lit(""))))
    pairs = F.arrays_zip(F.slice(states, F.lit(1), F.size(states) - 1).alias("a"), F.slice(states, F.lit(2), F.size(states) - 1).alias("b"))
    rows = (samples.select("random", F.explode(pairs).alias("p")).groupBy("random", "p.a", "p.b")
            .agg(F.count(F.lit(1)).alias("n")).collect())      # at most 2 * STATES ** 2 rows
    logs = {}
    for label, fixed in ((True, _random_strings()), (False, IDENTIFIERS)):
        c, own = [0.0] * STATES ** 2, [0.0] * STATES ** 2
        for r in rows:
            if r.random == label:
                c[r.a * STATES + r.b] += r.n
        for run in fixed:
            states = [0, *(ALPHABET.index(x) + 1 for x in run)]
            for a, b in zip(states, states[1:]):
                own[a * STATES + b] += 1
        # the fixed samples weigh as much as those of the corpus, at least once
        weight = max(1.0, sum(c) / sum(own))
        c = [x + weight * y for x, y in zip(c, own)]
        logs[label] = []
        for a in range(STATES):
            row = c[a * STATES:(a + 1) * STATES]
            total, even = sum(row), EVEN[label]
            logs[label] += [math.log((1 - even) * n / total + even / STATES if total else 1 / STATES) for n in row]
    return [r - o for r, o in zip(logs[True], logs[False])]


def log_ratio(run: Column, table: Column) -> Column:
    """Log-likelihood ratio of a run."""
    states = _states(run)
    before = F.concat(F.array(F.lit(0)), states)
    steps = F.zip_with(states, F.slice(before, F.lit(1), F.size(states)), lambda b, a: F.get(table, a * STATES + b))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def scan(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD,
         carry: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Columns ``carry``, ``base_spans`` and ``spans``, arrays of (start, kind,
    end) by start, then kind; kinds number :data:`KINDS`.

    Other columns are not read, whatever their names.  Null texts count as empty and have no spans.  A run that overlaps a base
    span adds nothing.  Rows are independent: repeated rows give repeated
    results and an empty table none.
    """
    table = F.array(*[F.lit(x) for x in ratios])
    found = base_spans(docs.select(*carry), text).withColumn("_runs", _pieces(F.col("_t"), RUN))
    found = found.withColumn("_more", _spans(F.col("_runs"), 3, lambda p: log_ratio(p, table) > threshold))
    # base spans in blocks with their reach: a run looks into the few blocks that reach it
    reach = F.transform(_blocks(F.col("_base")), lambda b: F.struct(
        F.array_min(F.transform(b, lambda s: s["start"])).alias("start"), F.array_max(F.transform(b, lambda s: s["end"])).alias("end"), b.alias("b")))
    meets = lambda m: lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"])
    apart = _let(reach, lambda rs: F.filter("_more", lambda m: ~F.exists(rs, lambda r: meets(m)(r) & F.exists(r["b"], meets(m)))))
    return (found.withColumn("base_spans", F.col("_base")).withColumn("spans", F.array_sort(F.concat("_base", apart)))
            .drop("_t", "_base", "_runs", "_more"))


def masked(scanned: DataFrame, text: str = "text") -> DataFrame:
    """``scanned`` with every span of the text replaced by :data:`MASK`,
    overlapping spans by one."""
    t = as_text(text)
    # spans in blocks, each with the part of the text from its first start to the
    # next block's, and the end of all spans before it
    def part(blocks: Column, firsts: Column, ends: Column, i: Column) -> Column:
        first = F.get(firsts, i)
        after = F.coalesce(F.get(firsts, i + 1), F.length(t))
        return F.struct(first.alias("first"), after.alias("after"), F.substring(t, first + 1, after - first).alias("text"),
                        F.greatest(first, F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0))).alias("at"),
                        F.get(blocks, i).alias("b"))

    def clean(r: Column) -> Column:
        begin = F.struct(r["at"].alias("at"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, s: Column) -> Column:
            before = F.substring(r["text"], a["at"] - r["first"] + 1, s["start"] - a["at"])
            # a span that starts before the end of an earlier one is part of its mask
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"),
                            F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(before, F.lit(MASK)))).otherwise(a["out"]).alias("out"))

        rest = lambda a: F.concat(F.array_join(a["out"], ""), F.when(a["at"] < r["after"], F.substring(
            r["text"], a["at"] - r["first"] + 1, r["after"] - a["at"])).otherwise(""))
        return F.aggregate(r["b"], begin, step, rest)

    def whole(blocks: Column) -> Column:
        firsts = F.transform(blocks, lambda b: F.get(b, F.lit(0))["start"])
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        parts = _let(firsts, lambda fs: _let(ends, lambda es: F.transform(blocks, lambda b, i: part(blocks, fs, es, i))))
        return F.concat(F.substring(t, F.lit(1), F.get(firsts, F.lit(0))), F.array_join(F.transform(parts, clean), ""))

    return scanned.withColumn(text, F.when(F.size("spans") > 0, _let(_blocks(F.col("spans")), whole)).otherwise(F.col(text)))


def written(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def model(docs: DataFrame, text: str = "text") -> list[float]:
    return train(materialise(labelled_samples(docs, text), "secret-samples"))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Per document the base counts, the hash of the base spans and all spans."""
    found = scan(docs, model(docs))
    n = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"))
