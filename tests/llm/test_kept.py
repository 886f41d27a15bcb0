"""An encoder keeps no more than it is told to, with the same ids."""

import json
import re
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

from parcelspark.llm import token_records
from parcelspark.llm.common import released
from parcelspark.llm.queries import TOKENIZER


def test_an_encoder_keeps_what_it_is_told_to():
    tokenizer = Tokenizer.from_file(str(TOKENIZER))
    encode = token_records.ChunkEncoder(tokenizer, "<u4", kept=2000)
    for k in range(20):
        texts = [f"word{k * 50 + i}, Another line{i}." for i in range(50)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == token_records.whole(tokenizer, texts)
        assert len(encode.known) < 300


def test_words_of_plain_letters_go_to_the_model_and_signs_stand_alone():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    encode, seen = token_records.ChunkEncoder(tokenizer, "<u4"), []
    marked = encode._marked
    encode._marked = lambda words: [seen.extend(words), marked(words)][1]
    texts = ["plain größe naïve ÿþ straße", "ends. with, signs!! été$$$ über,### a's. it'. x<|endoftext|>. 7%% €. e\u0301. Élan!! ...", "<|startoftext|>A.B.C", "ß.,. re. 's. ll;"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == token_records.whole(tokenizer, texts)
    assert not {w for w in seen if token_records.stem(w) or w.decode() in "plain größe naïve ÿþ straße été über"}


def test_another_use_of_letters_leaves_the_model_out():
    definition = json.loads(Path(TOKENIZER).read_text(encoding="utf-8"))
    definition["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "é"}, "content": "e"})
    assert token_records.plain_letters(Tokenizer.from_file(TOKENIZER)) and not token_records.plain_letters(Tokenizer.from_str(json.dumps(definition)))


def test_a_worker_gives_back_what_a_task_let_go():
    def run(batches):
        kept = [bytes(100) for _ in range(2_000_000)]  # small pieces, which the allocator keeps for itself
        yield from batches
        del kept

    mapped = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024
    before = mapped()
    assert list(released(run)(iter([1, 2]))) == [1, 2] and mapped() < before + 100
