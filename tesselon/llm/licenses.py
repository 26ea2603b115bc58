"""License scan by a positional rare-token index (op 1); DataFrame functions only.

Every template is a notice with a mandatory key phrase inside. The index posts each template under the two words
of its key phrase that are rarest over all documents (highest IDF). A document looks up those words, each hit
gives the template and the start that it implies, and a start that both rare words agree on is a candidate. A
candidate counts when the whole key phrase stands there; its score is the share of the notice's words that stand
at their relative positions.

Null and empty texts have no words, no labels and score 0. Repeated rows give equal rows. Other columns are ignored.
Texts of any length are scanned whole. Words that are equally rare go by their place in the phrase. The index is bounded by
the templates; only the document frequencies of their words (at most a few hundred rows) come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import ascii_lower

#: Everything that is not a word character, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    key: str
    notice: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)


TEMPLATES = (
    Template("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3", True),
    Template("apache", "apache license", "licensed under the apache license version 2 0", True),
    Template("cc-by", "cc by", "licensed under cc by 4 0", True),
    Template("mit", "mit license", "released under the mit license", True),
    Template("gpl-2.0", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3", "licensed under the gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "licensed under the gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    Template("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    Template("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    Template("cc0", "cc0 1 0", "dedicated to the public domain under cc0 1 0"),
    Template("mit-text", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose"),
    Template("mpl", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    Template("epl", "eclipse public license", "made available under the terms of the eclipse public license"),
    Template("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved", "copyright all rights reserved"),
)


def words(text):
    """Words of a lower-cased text as an array."""
    whole = F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP)
    return whole


def _trimmed(raw):
    """Without the empty pieces that split leaves at the ends."""
    lead = (F.get(raw, F.lit(0)) == "").cast("int")
    trail = (F.element_at(raw, -1) == "").cast("int")
    return F.slice(raw, 1 + lead, F.greatest(F.size(raw) - lead - trail, F.lit(0)))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of documents that hold each word of a bounded vocabulary."""
    own = F.array(*[F.lit(w) for w in vocabulary])
    seen = docs.select(F.explode(F.array_intersect(words(F.col("text")), own)).alias("w"))
    return {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}


def rare_words(templates, df: dict[str, int], keep: int = 2) -> list[list[tuple[str, int]]]:
    """For each template the places (word, position in the key) of its rarest distinct key words."""
    out = []
    for t in templates:
        places: dict[str, int] = {}
        for i, w in enumerate(t.key_words):
            places.setdefault(w, i)
        out.append(sorted(places.items(), key=lambda x: (df.get(x[0], 0), x[1]))[:keep])
    return out


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, places (template, start, score), and the summary columns of the scan."""
    vocabulary = sorted({w for t in templates for w in t.key_words})
    rare = rare_words(templates, document_frequencies(docs, vocabulary))
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, own in enumerate(rare):
        for w, at in own:
            postings.setdefault(w, []).append((k, at))

    def struct_of(**values):
        return F.struct(*[v.alias(k) for k, v in values.items()])

    index = F.create_map(*[x for w, p in sorted(postings.items()) for x in (F.lit(w), F.array(*[struct_of(t=F.lit(t), at=F.lit(at)) for t, at in p]))])
    about = F.array(*[
        struct_of(
            label=F.lit(t.label), base=F.lit(t.base), need=F.lit(len(own)), key_n=F.lit(len(t.key_words)), key_at=F.lit(t.key_at),
            key=F.array(*map(F.lit, t.key_words)), notice=F.array(*map(F.lit, t.words)),
        )
        for t, own in zip(templates, rare)
    ])
    anchors = sorted(postings)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("raw"))
    d = d.select("doc_id", _trimmed(F.col("raw")).alias("w"))
    hit = F.filter(F.transform("w", lambda w, i: F.when(w.isin(anchors), struct_of(w=w, i=i))), lambda x: x.isNotNull())
    d = d.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), hit.alias("hits"))
    implied = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(index, h["w"]), lambda p: struct_of(t=p["t"], s=h["i"] - p["at"]))))
    d = d.select("doc_id", "w", "n_words", F.sort_array(implied).alias("all"))
    # equal neighbours in sorted order: as many as the template has rare words
    agreed = F.filter("all", lambda x, i: (x["s"] >= 0) & (F.get(F.col("all"), i + F.element_at(about, x["t"] + 1)["need"] - 1) == x))
    d = d.select("doc_id", "w", "n_words", agreed.alias("cand"))

    def verified(x):
        t = F.element_at(about, x["t"] + 1)
        return F.slice(F.col("w"), x["s"] + 1, t["key_n"]) == t["key"]

    def placed(x):
        t = F.element_at(about, x["t"] + 1)
        same = F.size(F.filter(t["notice"], lambda w, k: F.get(F.col("w"), F.greatest(x["s"] - t["key_at"] + k, F.lit(-1))) == w))
        return struct_of(label=t["label"], base=t["base"], start=x["s"].cast("long"), score=same / F.size(t["notice"]))

    d = d.select("doc_id", "n_words", F.transform(F.filter("cand", verified), placed).alias("places"))
    base = F.filter("places", lambda p: p["base"])
    d = d.select("doc_id", "n_words", "places", base.alias("b"))

    def joined(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    starts = F.transform("b", lambda p: p["start"])
    return d.select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined("b").alias("base_labels"), joined("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"), "places",
    )


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("places")


def oracle(templates=TEMPLATES) -> str:
    """The same rows from a join of all words with all notice words (no index)."""
    rows = ",\n".join(
        f"({k}, '{t.label}', {str(t.base).lower()}, {t.key_at}, {len(t.key_words)}, {len(t.words)}, {p}, '{w}')"
        for k, t in enumerate(templates) for p, w in enumerate(t.words)
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH t(k, label, base, key_at, key_n, n, p, w) AS (VALUES {rows}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
m AS (SELECT r, k, label, base, i - p + key_at AS s, key_n, n, count(*) AS c, count(*) FILTER (p >= key_at AND p < key_at + key_n) AS kc
      FROM dw JOIN t USING (w) GROUP BY ALL),
v AS (SELECT * FROM m WHERE kc = key_n)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, count(v.k) FILTER (base)::BIGINT AS n_base,
  min(s) FILTER (base)::BIGINT AS first_word, max(s) FILTER (base)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(c / n::DOUBLE), 0) AS score
FROM d LEFT JOIN v USING (r) GROUP BY d.r, d.doc_id, d.ws
"""
