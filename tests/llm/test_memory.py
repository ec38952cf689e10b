"""A reused Python worker keeps no memory of the stages that it ran."""

import re
import time
from pathlib import Path

import numpy as np

from tilewright.llm import common, packing, tokens


def held_mb() -> float:
    return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def words(n: int) -> str:
    letters = "abcdefghijklmnopqrstuvwxyz"
    return " ".join("".join(letters[i // 26**k % 26] for k in range(4)) + letters[i % 7 :][:6] for i in range(n))


def test_another_stage_drops_what_packing_remembers():
    encoder = packing.Encoder(tokens.installed(packing.FILE))
    encoder.encode(["warm"])
    common.release()
    before, text = held_mb(), words(200_000)
    ids = encoder.encode([text])
    list(common.tidy(iter, packing._own)(iter([1])))  # its own next task
    assert packing._known
    list(common.tidy(iter)(iter([1])))
    assert not packing._known and not packing._models and not tokens._known
    size = len(ids[0]) / (1 << 20)
    del encoder, ids, text
    common.trim()
    assert held_mb() - before < 10 + size


def test_packing_encodes_a_word_once():
    """Seconds of the same words again; a memory that is too small for them starts anew each time."""
    encoder, lots, seconds = packing.Encoder(tokens.installed(packing.FILE)), words(420_000).split(" "), []
    texts = [" ".join(lots[:210_000]), " ".join(lots[210_000:])]
    for _ in range(2):
        began = time.process_time()
        got = [encoder.encode([t])[0] for t in texts]
        seconds.append(time.process_time() - began)
    common.release()
    assert len(set(lots)) > 400_000 and len(got) == len(texts)
    assert seconds[1] < seconds[0] / 2, seconds


def test_a_stage_gives_its_memory_and_tables_back():
    table: dict = {}
    common.TABLES.append(table)
    kept = []

    def stage(batches):
        table["big"] = np.ones(1 << 20)
        for b in batches:
            small = [bytes(2000) for _ in range(20_000)]  # below the size that the system takes back by itself
            kept.append(small[::1000])
            yield b

    try:
        before = held_mb()
        assert list(common.tidy(stage)(iter([1, 2, 3]))) == [1, 2, 3]
        assert not table and held_mb() - before < 15
    finally:
        common.TABLES.remove(table)
    assert common.tidy_group(lambda g: g + 1)(1) == 2
