"""Personal data: patterns, and terms that disclose them by co-occurrence in the corpus.

Patterns find the protected entities. A word of a text that holds an entity discloses it when the
corpus ties the two together: their pointwise mutual information, as a share of the entity's own
information content, reaches a threshold, with enough different texts to tell it from chance. Such
words are spans too, wherever they stand in the texts that hold the entity, and sanitising
generalises them along with the entities.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm.shared import by_size, cut, lean, slices, table

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information content that a word may disclose at most.
THRESHOLD = 0.75
#: Different texts that have to hold both a word and an entity.
CONTEXTS = 3
#: Code points of text in a chunk; a longer text is a chunk by itself.
CHUNK = 2_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs, so that time is linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_DIGIT.findall(m[0]))
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else ''.join(re.findall('[0-9.]' if kind == 'ip' else '[0-9]', value))}"


def free_words(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of the runs of letters and digits outside every span."""
    taken = sorted((a, b) for _, a, b in spans)
    at, end = 0, 0
    for m in _WORD.finditer(text):
        x, y = m.span()
        while at < len(taken) and taken[at][0] < y:
            end = max(end, taken[at][1])
            at += 1
        if x >= end:
            yield m[0].lower(), x, y


def _mark(text: str) -> bytes:
    """The digest that Spark's sha2 gives of the text."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entities of each text, and the text itself if it has any."""
    for batch in slices(batches, 1024):
        marks, spans, entities, held = [], [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            found = base_spans(text)
            marks.append(_mark(text))
            spans.append(joined(found))
            entities.append(sorted({_entity(kind, text[a:b]) for kind, a, b in found}))
            held.append(text if found else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(marks, pa.binary()), pa.array(spans, pa.string()), pa.array(entities, pa.list_(pa.string())), pa.array(held, pa.string())],
            names=["id", "mark", "base", "entities", "held"],
        )


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each word, summed over a few hundred of them before they are shuffled."""

    def flush(counts):
        words = list(counts)
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["term", "n"]
            )

    counts: Counter[str] = Counter()
    for batch in slices(batches, 1024):
        for text in batch.column(0).to_pylist():
            counts.update(set(_WORD.findall((text or "").lower())))
            if len(counts) > 200_000:
                yield from flush(counts)
                counts.clear()
    yield from flush(counts)


_TEXT = pa.struct(
    [("mark", pa.binary()), ("held", pa.string()), ("copies", pa.int64()), ("entities", pa.list_(pa.struct([("entity", pa.string()), ("n", pa.int64())])))]
)
_CHUNK_SCHEMA = (
    "chunk long, texts array<struct<mark: binary, held: string, copies: long, entities: array<struct<entity: string, n: long>>>>, words array<string>"
)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of about CHUNK code points in one row, with the different words outside their spans."""

    def flush():
        nonlocal number, size
        columns = [pa.array([number], pa.int64()), pa.array([texts], pa.list_(_TEXT)), pa.array([sorted(words)], pa.list_(pa.string()))]
        number, size = number + 1, 0
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "texts", "words"])

    number, size, texts, words = TaskContext.get().partitionId() << 32, 0, [], set()
    for batch in slices(batches, 256):
        for row in batch.to_pylist():
            if texts and size + len(row["held"]) > CHUNK:
                yield flush()
                texts, words = [], set()
            texts.append(row)
            size += len(row["held"])
            words.update(w for w, _, _ in free_words(row["held"], base_spans(row["held"])))
    if texts:
        yield flush()


def _candidates(total: int, threshold: float):
    """Pairs of an entity and a word of its texts that can disclose, summed over a chunk.

    A word t discloses e if n(t,e) >= n(t) (n(e) / N)^(1 - threshold), and n(t,e) is n(e) at most: so
    n(t) is n(e)^threshold N^(1 - threshold) at most, which is known before any pair is made.
    """

    def run(batches):
        for batch in slices(batches, 1):
            for chunk, texts, known in zip(*(batch.column(c).to_pylist() for c in ("chunk", "texts", "known"))):
                known = {k["term"]: k["n"] for k in known}
                sums: dict[tuple[str, str], list[int]] = {}
                for text in texts:
                    words = {w for w, _, _ in free_words(text["held"], base_spans(text["held"])) if w in known}
                    ranked = sorted((known[w], w) for w in words)
                    for e in text["entities"]:
                        most = e["n"] ** threshold * total ** (1 - threshold) * (1 + 1e-9)
                        for n, w in ranked:
                            if n > most:
                                break
                            own = sums.setdefault((e["entity"], w), [0, 0, e["n"], n])
                            own[0] += 1
                            own[1] += text["copies"]
                pairs = list(sums)
                for i in range(0, len(pairs), 50_000):
                    part = pairs[i : i + 50_000]
                    columns = [pa.array([chunk] * len(part), pa.int64()), *(pa.array(c, pa.string()) for c in zip(*part))]
                    columns += [pa.array([sums[p][k] for p in part], pa.int64()) for k in range(4)]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "entity", "term", "texts", "n_both", "n_entity", "n_term"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of all occurrences of each text's disclosing words."""
    for batch in slices(batches, 1):
        for texts, told in zip(*(batch.column(c).to_pylist() for c in ("texts", "told"))):
            of: dict[str, set[str]] = {}
            for pair in told:
                of.setdefault(pair["entity"], set()).add(pair["term"])
            marks, spans = [], []
            for text in texts:
                terms = set().union(*(of.get(e["entity"], ()) for e in text["entities"]))
                if terms:
                    held = text["held"]
                    marks.append(text["mark"])
                    spans.append(joined(("term", x, y) for w, x, y in free_words(held, base_spans(held)) if w in terms))
            some = [m for m, t in zip(marks, spans) if t], [t for t in spans if t]
            yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.binary()), pa.array(some[1], pa.string())], names=["term_mark", "terms"])


def disclosing_terms(found: DataFrame, texts: DataFrame, threshold: float, contexts: int) -> DataFrame:
    """``term_mark``, ``terms``: the spans of the disclosing words of each different text that has any.

    With N texts, PMI = log(N n(t,e) / (n(t) n(e))) and the entity's content IC = log(N / n(e)), n
    counting texts; the pair is disclosing if PMI >= threshold * IC. The texts of all of the corpus
    are counted, copies included, but as support of a pair equal texts count once.

    The different texts that hold an entity with support are put in chunks. A chunk is told how
    frequent its words are, sends sums over the pairs that can disclose, and is told which of them do.
    So what is shuffled is sums, however many texts share an entity.
    """
    total = texts.count()
    rows = found.where("size(entities) > 0").select("id", "mark", "entities").dropDuplicates(["id", "mark"])
    marks = cut(rows.groupBy("mark").agg(F.first("entities").alias("entities"), F.count(F.lit(1)).alias("copies")))
    each = marks.select("mark", "copies", F.explode("entities").alias("entity"))
    # An entity in too few different texts cannot have a pair in enough of them; one in all texts discloses nothing.
    counted = each.groupBy("entity").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("texts"))
    entities = cut(counted.where((F.col("texts") >= contexts) & (F.col("n") < total)).select("entity", "n"))
    kept = each.join(by_size(entities), "entity").groupBy(F.col("mark").alias("kept"))
    kept = cut(kept.agg(F.first("copies").alias("copies"), F.collect_list(F.struct("entity", "n")).alias("entities")))
    held = found.where("held IS NOT NULL").select("mark", "held")
    held = held.join(by_size(kept), F.col("mark") == F.col("kept")).select("mark", "held", "copies", "entities").dropDuplicates(["mark"])
    chunks = cut(held.mapInArrow(lean(_chunks), _CHUNK_SCHEMA))

    most = (entities.agg(F.max("n")).first()[0] or 0) ** threshold * total ** (1 - threshold) * (1 + 1e-9)
    counts = texts.select("text").mapInArrow(lean(_frequencies), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = counts.where((F.col("n") >= contexts) & (F.col("n") <= most))
    known = chunks.select(F.col("chunk").alias("of"), F.explode("words").alias("term")).join(counts, "term")
    known = known.groupBy("of").agg(F.collect_list(F.struct("term", "n")).alias("known"))
    schema = "chunk long, entity string, term string, texts long, n_both long, n_entity long, n_term long"
    pairs = chunks.select("chunk", "texts").join(known, F.col("chunk") == F.col("of")).drop("of")
    pairs = cut(pairs.mapInArrow(lean(_candidates(total, threshold)), schema))

    sums = [F.sum("texts").alias("texts"), F.sum("n_both").alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term")]
    both = pairs.groupBy("entity", "term").agg(*sums).where(F.col("texts") >= contexts)
    shared = F.log(F.lit(total) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    content = F.log(F.lit(total) / F.col("n_entity"))
    passing = both.where((content > 0) & (shared >= threshold * content)).select("entity", "term")
    told = pairs.join(by_size(cut(passing)), ["entity", "term"], "left_semi").groupBy(F.col("chunk").alias("of"))
    told = told.agg(F.collect_list(F.struct("entity", "term")).alias("told"))
    out = chunks.select("chunk", "texts").join(told, F.col("chunk") == F.col("of")).drop("of")
    return out.mapInArrow(lean(_places), "term_mark binary, terms string")


def _found(df: DataFrame, key: str, text: str, threshold: float, contexts: int) -> tuple[DataFrame, DataFrame]:
    texts = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    found = cut(texts.mapInArrow(lean(_base), f"id {id_type}, mark binary, base string, entities array<string>, held string"))
    return found, cut(disclosing_terms(found, texts, threshold, contexts))


def find(
    df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, contexts: int = CONTEXTS
) -> DataFrame:
    """``id``, ``mark`` (digest of the text), ``base`` and ``terms`` (spans as kind:start:end) per row of df.

    A null text is empty; an empty table finds nothing. Rows that repeat an id and text find the same
    spans. Columns of df other than ``key`` and ``text`` play no part.
    """
    found, terms = _found(df, key, text, threshold, contexts)
    found = found.join(by_size(terms), F.col("mark") == F.col("term_mark"), "left")
    return found.select("id", "mark", "base", F.coalesce("terms", F.lit("")).alias("terms"))


def sanitise(
    df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, contexts: int = CONTEXTS
) -> DataFrame:
    """df with entities and disclosing terms replaced by their kind, as in [EMAIL]; other columns as they are.

    Spans that overlap are replaced together, by the kind of the first. A null text stays null. A row
    is matched with its terms by the digest of its text, so null and repeated ids do no harm.
    """
    _, terms = _found(df, key, text, threshold, contexts)
    names = df.columns

    def run(batches):
        for batch in slices(batches, 1024):
            out = []
            for value, own in zip(batch.column(names.index(text)).to_pylist(), batch.column(len(names)).to_pylist()):
                if value is None:
                    out.append(None)
                    continue
                spans = [(k, int(a), int(b)) for k, a, b in (t.split(":") for t in own.split(","))] if own else []
                out.append(replaced(value, base_spans(value) + spans))
            columns = [*batch.columns[: len(names)]]
            columns[names.index(text)] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    terms = by_size(terms.select(F.col("term_mark").alias("__of"), F.col("terms").alias("__terms")))
    same = F.unhex(F.sha2(F.col(f"`{text}`").cast("binary"), 256)) == F.col("__of")
    rows = df.select(*[F.col(f"`{c}`") for c in names]).join(terms, same, "left").drop("__of")
    return rows.mapInArrow(lean(run), df.schema)


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind):
        return (F.size(F.split("base", f"{kind}:")) - 1).cast("long").alias(f"n_{kind}")

    return find(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in KINDS],
        F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", F.expr("nullif(base, '')"), F.expr("nullif(terms, '')")).alias("spans"),
    )
