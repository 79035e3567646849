"""Subject areas of documents by seeded non-negative factorisation.

The document-term matrix V is factored as V ~ W H with multiplicative updates of
the Kullback-Leibler objective.  Each subject owns a component that starts on its
seed words and stays anchored to them: a seed of one subject is held at zero in
the others.  Free components take up what belongs to no subject.  With H fitted on
all documents, a sentence's mixture comes from the same update with H held; a
document has the subjects that lead in a quarter or more of its sentences.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kisaran.session import cut_lineage

# Seed words of each subject, English and Indonesian.
SEEDS = {
    "prices": "price prices priced quote quotes quoted dearer cheaper asking rupiah harga banderol kutipan termahal termurah dibanderol",
    "weather": "rain rains rainfall monsoon wind winds windy fog humidity drizzle lightning forecast outlook skies clouds storm temperature temperatures degrees hujan angin kabut kelembapan gerimis petir prakiraan awan badai suhu derajat monsun cuaca rintik",
    "crops": "crop crops planting planted seedlings seeds soil harvest harvested orchard blight irrigation farmers growers ripened sprouted potassium weeds mulch tanam menanam benih bibit panen kebun hawar irigasi petani berbuah bertunas bedengan kalium gulma sawah ladang mulsa",
    "fisheries": "fish fishing fishers fishermen catch trawl trawlers boats nets hatchery spawned spawning landing reef mangrove salinity plankton nelayan melaut jala tangkapan memijah tambak keramba perahu palka terumbu bakau salinitas salinitasnya pelelangan",
    "livestock": "cattle cow cows calf calves goats hens broiler broilers poultry herd dairy barn fodder weaning vaccinated veterinarian vet dewormed slaughterhouse ternak sapi unggas kandang pakan hijauan bertelur divaksin mantri sapih afkir diafkir perah pedet",
    "logistics": "truck trucks lorry lorries freight cargo container containers depot warehouse warehouses forklift forklifts consignment dispatch weighbridge dock berth truk muatan kontainer kemas depo gudang kiriman sopir dermaga jembatan timbang pengiriman angkutan bongkar",
    "law": "court courts judge judges tribunal licence licences permit permits statute statutory clause injunction warrant hearing appeal inspectors judicial ombudsman pengadilan hakim majelis izin perizinan denda sidang gugatan tergugat ketentuan arbitrase materi yudisial pasal",
    "finance": "credit loan loans lending bond bonds yields shares debtors creditors covenant collateral liquidity treasurer auditors insurance premiums refinanced kredit pinjaman obligasi saham bunga laba debitur neraca auditor agunan asuransi triwulan likuiditas bendahara",
    "health": "patients clinic clinics nurse nurses midwives anaemia anemia immunisation vitamin vitamins nutrition nutritionist fever poisoning hospital hygiene stunting supplements pasien puskesmas perawat bidan imunisasi gizi demam keracunan oralit tengkes suplemen natrium bangsal",
    "software": "software server servers database login parser bug script cache module endpoint json regex commit hotfix deploy compiled exception scraper perangkat peladen skrip modul kode terkompilasi pustaka klaster komit basis singgahan pengurai proksi",
    "energy": "electricity power solar diesel generator generators grid battery batteries fuel inverter substation kilowatt kilowatts blackout transformer biogas voltage listrik daya surya genset baterai gardu inverter padam trafo bakar tegangan turbin",
    "sport": "match matches team teams goal goals league coach striker goalkeeper tournament referee halftime cup fixture stadium penalty pertandingan tim gol liga pelatih penyerang kiper turnamen wasit babak piala stadion laga penalti gelandang",
}

_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+|(?<=[a-z][.!?])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]{3,}")


@dataclass(frozen=True)
class SubjectParams:
    """``buckets``: width of the hashed vocabulary (bounds H).  ``free``: components
    without a subject.  ``rounds``: alternations over all documents,
    ``inner`` and ``judge_inner``: updates of W in each and in the final pass.  ``share``:
    part of the sentences that makes a subject count.  ``themed``: what part of a
    sentence's weight must lie on subjects at all, ``lead``: and what part of that
    on the leading one."""

    buckets: int = 1 << 14
    free: int = 3
    rounds: int = 8
    inner: int = 6
    judge_inner: int = 10
    share: float = 0.22
    themed: float = 0.15
    lead: float = 0.5


def plain(text: str) -> str:
    """Text without markup and invisible signs, in composed form."""
    s = re.sub(r"<[^<>]{0,200}>", " ", html.unescape(text))
    s = unicodedata.normalize("NFKC", s)
    return re.sub("[­​-‏⁠﻿]", "", s)


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence with any word of three letters or more."""
    if not text:
        return []
    out = [_WORD.findall(s.casefold()) for s in _SENTENCE.split(plain(text))]
    return [w for w in out if w]


def bucket(word: str, buckets: int) -> int:
    return xxhash.xxh32_intdigest(word) % buckets


class _Index:
    """Bucket numbers of words, kept for a task."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.known = buckets, {}

    def __call__(self, words: list[str]) -> list[int]:
        out = []
        for w in words:
            b = self.known.get(w)
            if b is None:
                if len(self.known) > 500_000:
                    self.known.clear()
                b = self.known[w] = bucket(w, self.buckets)
            out.append(b)
        return out


def _sparse(rows: list[list[int]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of lists of bucket numbers."""
    sizes = [len(r) for r in rows]
    if not sum(sizes):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    r = np.repeat(np.arange(len(rows)), sizes)
    key, n = np.unique(r * buckets + np.concatenate([np.asarray(x, np.int64) for x in rows if len(x)]), return_counts=True)
    return key // buckets, key % buckets, n.astype(float)


def mixtures(r: np.ndarray, c: np.ndarray, v: np.ndarray, n_rows: int, h: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Row mixtures W (rows sum to their counts) with H held, and the last ratio
    V / WH at the filled places.  ``r`` ascends and every row has a filled place."""
    w = np.ones((n_rows, len(h)), np.float32)
    hc = np.ascontiguousarray(h.T[c], np.float32)  # filled places x components
    first = np.searchsorted(r, np.arange(n_rows))
    v = v.astype(np.float32)
    ratio = v
    for _ in range(inner):
        ratio = v / np.maximum(np.einsum("ij,ij->i", w[r], hc), 1e-30)
        w *= np.add.reduceat(hc * ratio[:, None], first, axis=0)
    return w, ratio


def start(params: SubjectParams, frequency: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """First H, the mask of places held at zero, and the subjects' names.

    ``frequency``: occurrences of each bucket, ``spread``: part of the documents
    that have it.  Free components start on words that are everywhere, the others
    on their seeds and, faintly, on words that are not.
    """
    names = list(SEEDS)
    k = len(names) + params.free
    mask = np.ones((k, params.buckets))
    taken = [{bucket(w, params.buckets) for w in SEEDS[s].split()} for s in names]
    for i, own in enumerate(taken):
        for b in own:
            if sum(b in t for t in taken) == 1:
                mask[:, b] = 0.0
                mask[i, b] = 1.0
    rare = frequency * (1 - spread) ** 8 + 1e-9
    common = frequency * spread**0.5 + 1e-9
    h = np.zeros((k, params.buckets))
    for i, own in enumerate(taken):
        h[i] = 0.4 * rare / rare.sum()
        share = rare[list(own)] + 1.0
        h[i, list(own)] += 0.6 * share / share.sum()
    for j in range(params.free):  # free components start on different slices of the vocabulary
        h[len(names) + j] = common * np.where(np.arange(params.buckets) % params.free == j, 1.5, 1.0)
    h *= mask
    return h / h.sum(axis=1, keepdims=True), mask, names


def _tree_sum(parts: DataFrame, shape: tuple[int, int], fan_in: int = 16) -> np.ndarray:
    """Sum of matrices held as one binary column, ``fan_in`` at a time; only the
    last one reaches the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape[0] * shape[1])
        for pdf in batches:
            for blob in pdf["m"]:
                total += np.frombuffer(blob, np.float32)
        yield pd.DataFrame({"m": [total.astype(np.float32).tobytes()]})

    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = max(1, n // fan_in)
        parts = parts.repartition(n).mapInPandas(add, "m binary")
    rows = parts.collect()
    return sum((np.frombuffer(x["m"], np.float32).astype(float) for x in rows), np.zeros(shape[0] * shape[1])).reshape(shape)


def fit(documents: DataFrame, params: SubjectParams = SubjectParams()) -> tuple[np.ndarray, list[str]]:
    """H over all documents, and the names of its anchored components.

    Scale: texts are turned into bucket counts once and written to the shared
    checkpoint folder; each round is one pass that sends a components x buckets
    matrix per partition (0.5 MB at the defaults) up a reduction tree.  H is
    bounded by the hashed vocabulary however large the corpus.
    """
    b, k = params.buckets, len(SEEDS) + params.free

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Index(b)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                ids = index([w for s in sentences(text) for w in s])
                if ids:
                    c, n = np.unique(np.asarray(ids, np.int32), return_counts=True)
                    rows.append((c.tolist(), n.tolist()))
            yield pd.DataFrame({"c": [r[0] for r in rows], "n": [r[1] for r in rows]})

    counts = cut_lineage(documents.where("text is not null").select("text").mapInPandas(count, "c array<int>, n array<int>"))

    def frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, b))
        for pdf in batches:
            if len(pdf):
                at = np.concatenate(pdf["c"].to_list())
                total[0] += np.bincount(at, np.concatenate(pdf["n"].to_list()), b)
                total[1] += np.bincount(at, minlength=b)
                total[2, 0] += len(pdf)
        yield pd.DataFrame({"m": [total.astype(np.float32).tobytes()]})

    seen = _tree_sum(counts.mapInPandas(frequency, "m binary"), (3, b))
    h, mask, names = start(params, seen[0], seen[1] / max(seen[2, 0], 1.0))
    for _ in range(params.rounds):
        now = h

        def update(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            total = np.zeros((k, b))
            for pdf in batches:
                for at in range(0, len(pdf), 400):
                    part = pdf.iloc[at : at + 400]
                    sizes = part["c"].map(len).to_numpy()
                    r = np.repeat(np.arange(len(part)), sizes)
                    c, v = np.concatenate(part["c"].to_list()), np.concatenate(part["n"].to_list()).astype(float)
                    v /= np.sqrt(np.bincount(r, v, len(part)))[r]  # long texts count less than by length
                    w, ratio = mixtures(r, c, v, len(part), now, params.inner)
                    for j in range(k):
                        total[j] += np.bincount(c, w[r, j] * now[j, c] * ratio, b)
            yield pd.DataFrame({"m": [total.astype(np.float32).tobytes()]})

        h = (_tree_sum(counts.mapInPandas(update, "m binary"), (k, b)) + 1e-7) * mask
        h /= h.sum(axis=1, keepdims=True)
    return h, names


def sentence_shares(texts: list[str | None], h: np.ndarray, names: list[str], params: SubjectParams, index: _Index) -> list[dict[str, float]]:
    """For each text the part of its sentences that each subject leads."""
    split = [sentences(t) for t in texts]
    rows = [index(w) for doc in split for w in doc]
    owner = np.repeat(np.arange(len(texts)), [len(d) for d in split])
    s = len(names)
    h = np.ascontiguousarray(h, np.float32)
    out: list[dict[str, float]] = [{} for _ in texts]
    sizes = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts))
    led = np.zeros((len(texts), s))
    for at in range(0, len(rows), 4000):
        part = rows[at : at + 4000]
        r, c, v = _sparse(part, params.buckets)
        w, _ = mixtures(r, c, v, len(part), h, params.judge_inner)
        lead = w[:, :s].argmax(axis=1)
        best, themed = w[np.arange(len(part)), lead], w[:, :s].sum(axis=1)
        sure = (best >= params.lead * themed) & (themed >= params.themed * w.sum(axis=1))
        np.add.at(led, (owner[at : at + len(part)][sure], lead[sure]), 1.0)
    for d in range(len(texts)):
        if sizes[d]:
            out[d] = {names[j]: led[d, j] / sizes[d] for j in np.flatnonzero(led[d])}
    return out


def subject_shares(documents: DataFrame, params: SubjectParams = SubjectParams()) -> DataFrame:
    """doc_id, subject, share: the part of a document's sentences that a subject leads.

    NULL, empty and wordless texts have no rows; whole texts are read, however
    long; repeated documents each have their own rows; ties between subjects in a
    sentence go to the first.  An empty table gives an empty result.  Extra
    columns are ignored.
    """
    h, names = fit(documents, params)
    sent = documents.sparkSession.sparkContext.broadcast(h.astype(np.float32))  # bounded: components x buckets

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, held = _Index(params.buckets), sent.value.astype(float)
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                shares = sentence_shares(part["text"].to_list(), held, names, params, index)
                rows = [(i, s, x) for i, d in zip(part["doc_id"], shares) for s, x in d.items()]
                yield pd.DataFrame(rows, columns=["doc_id", "subject", "share"])

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(judge, "doc_id long, subject string, share double")


def subject_areas(documents: DataFrame, params: SubjectParams = SubjectParams()) -> DataFrame:
    """doc_id, subject of every subject that a quarter of the sentences, about, deal with."""
    return subject_shares(documents, params).where(F.col("share") >= params.share).select("doc_id", "subject")
