import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from inkshard.llm.packing import WordTokenizer, best_fit, pack_documents, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_tokenizer_gives_the_ids_of_the_library():
    own, library = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    odd = ["a\0b", "Hello  wOrld's don't 123abc ### x", "é́ É á", "x<|endoftext|> hi <|EndOfText|>", "İ ß ΣΑΣ ς", " x　y\x1fz\x85q", "", "  ", "...,a..b 'S", "漢字 한 글"]
    odd += ["word. word, (word) word%%% wo''rd''. x'. 'x, é, …, é…, 5% 5.5 a-b- -- end", "²², ẋ̣. ½!"]
    want = [library.encode(t, add_special_tokens=False).ids for t in odd]
    for texts in (pa.array(odd), pa.array(["x", *odd, None])[1:]):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in own.ids(texts)][: len(odd)] == want
    assert list(own.ids(pa.array([None, "", " \n"]))) == [b""] * 3 and list(own.ids(pa.array([], pa.string()))) == []


def packed(df, limit):
    rows = pack_documents(df, PATH, limit).collect()
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limit
    return rows, len(filled)


def test_awkward_rows(awkward, nothing):
    limit = 64
    rows, _ = packed(awkward, limit)
    library = Tokenizer.from_file(PATH)
    want = []
    for r in awkward.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for i, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            want.append((r.doc_id, i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    assert pack_documents(nothing, PATH).collect() == []


def test_few_sequences_and_their_ids(documents):
    rows, n = packed(documents, 2048)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 2048) + 1
    whole = sequences(pack_documents(documents, PATH, keep_ids=True)).collect()
    assert sum(r.n_ids for r in whole) == total and all(len(r.ids) == 4 * r.n_ids <= 4 * 2048 for r in whole)


def plain_best_fit(lengths, limit):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(limit - n)
    return len(gaps)


def test_runs_pack_as_well_as_pieces_one_by_one():
    rng = random.Random(4)
    for limit in (10, 64, 2048):
        for size in (1, 7, 400):
            lengths = [min(limit, 1 + int(rng.expovariate(4 / limit))) for _ in range(size)]
            counts = {n: lengths.count(n) for n in lengths}
            plan = best_fit(counts, limit)
            places = defaultdict(int)
            for n, count in counts.items():
                mine = plan[plan[:, 0] == n]
                for rank in range(count):
                    run = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
                    key = (run[2] + rank - run[1], run[3])
                    assert key not in places
                    places[key] = n
            ends = defaultdict(list)
            for (sequence, offset), n in places.items():
                ends[sequence].append((offset, n))
            for pieces in ends.values():
                at = 0
                for offset, n in sorted(pieces):
                    assert offset == at
                    at += n
                assert at <= limit
            assert len(ends) <= plain_best_fit(lengths, limit) * 1.05 + 1
    assert best_fit({}).shape == (0, 4)


def test_words_go_to_the_tokenizer_in_bounded_portions(monkeypatch):
    from inkshard.llm import packing

    monkeypatch.setattr(packing, "AT_ONCE", 7)
    own, library = WordTokenizer(PATH, remember=10), Tokenizer.from_file(PATH)
    given, encode = [], own.plain.encode
    own.plain = type("Counted", (), {"encode": lambda self, text, **k: (given.append(len(text.split())), encode(text, **k))[1]})()
    texts = [" ".join(f"wo{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} x{i}y!" for i in range(n)) for n in (50, 0, 100, 50)]
    ids = [np.frombuffer(i, "<u4").tolist() for t in texts for i in own.ids(pa.array([t]))]
    assert ids == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(given) <= 7 and len(own.known) <= 10
