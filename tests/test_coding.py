"""Codecs and transforms without Spark: round trips, known values, errors."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytewright.operators import codec, lanes, transforms
from bytewright.plans.parameters import Parameters

MODELS = [*codec.REGISTRY]


@pytest.mark.parametrize(("text", "out", "row"), [(b"banana", b"annbaa", 4), (b"mississippi", b"ipssmpissii", 5), (b"x", b"x", 1), (b"", b"", 0)])
def test_bwt_known(text, out, row):
    assert transforms.bwt(text) == (out, row)


def test_mtf_known():
    assert list(transforms.mtf(bytes([2, 2, 2, 1, 5, 5]))) == [2, 1, 0, 2, 5, 1]


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.binary(max_size=300), st.text(alphabet="ab", max_size=300).map(str.encode)))
def test_transforms_undo(data):
    assert transforms.unmtf(transforms.mtf(data)) == data
    assert transforms.unbwt(*transforms.bwt(data)) == data


@settings(max_examples=40, deadline=None)
@given(st.one_of(st.binary(max_size=300), st.text(alphabet="ab", max_size=300).map(str.encode)))
def test_both_sorts_agree(data):
    short = transforms.suffix_order(data).tolist()
    transforms.SHORT, held = -1, transforms.SHORT
    try:
        assert transforms.suffix_order(data).tolist() == short
    finally:
        transforms.SHORT = held


@pytest.mark.parametrize("data", [b"a" * 65536, bytes(range(256)) * 20])
def test_bwt_large(data):
    assert transforms.unbwt(*transforms.bwt(data)) == data


def test_unbwt_bad_row():
    with pytest.raises(ValueError):
        transforms.unbwt(b"abc", 9)


@pytest.mark.parametrize("model", MODELS)
@settings(max_examples=15, deadline=None)
@given(blocks=st.lists(st.binary(max_size=120), max_size=4))
def test_codec_round_trip(model, blocks):
    """Several blocks, and then a second file with a fresh codec."""
    for _ in range(2):
        encoder, decoder = codec.codec_of(model), codec.codec_of(model)
        for block in blocks:
            assert decoder.decode(encoder.encode(block), len(block)) == block


@pytest.mark.parametrize("model", ["O0", "O1FPAQ", "O0FIX"])
def test_rescale_and_size(model):
    rng = random.Random(5)
    data = bytes(rng.choices(range(4), [8, 4, 2, 1], k=70_000))
    coded = codec.codec_of(model).encode(data)
    assert codec.codec_of(model).decode(coded, len(data)) == data
    assert len(coded) < 70_000 * 1.75 / 8 + 600


def test_size_near_ideal():
    data = random.Random(1).choices(range(40), k=20_000)
    m = codec.Adaptive(0)
    ideal = sum(m.cost(s) for s in data) / 8
    assert 0 <= len(codec.codec_of("O0").encode(bytes(data))) - ideal < 40


def test_cut_payload_is_an_error():
    data = random.Random(2).randbytes(500)
    with pytest.raises(codec.CorruptError):
        codec.codec_of("O0").decode(codec.codec_of("O0").encode(data)[:100], 500)


def test_carries():
    """Runs of highest bytes carry through what is written; every prefix of them decodes."""
    rng = random.Random(7)
    for _ in range(400):
        puts = [(t - 1, 1, t) if rng.random() < 0.9 else (rng.randrange(t), 1, t) for t in (rng.choice([2, 3, 255, 4096, 65536]) for _ in range(rng.randrange(40)))]
        coder = codec.Encoder()
        for put in puts:
            coder.put(*put)
        data = coder.finish()
        decoder = codec.Decoder(data)
        for start, size, total in puts:
            assert start <= decoder.target(total) < start + size
            decoder.take(start, size)
        assert len(data) <= sum(t.bit_length() for *_, t in puts) / 8 + 2


def test_own_model_is_registered():
    codec.REGISTRY["TEST"] = lambda: codec.FileCodec(codec.Adaptive(0))
    try:
        assert codec.codec_of("TEST").decode(codec.codec_of("TEST").encode(b"abc"), 3) == b"abc"
    finally:
        del codec.REGISTRY["TEST"]
    with pytest.raises(ValueError):
        codec.codec_of("TEST")


@pytest.mark.parametrize("bad", [{"model": "O0FIX"}, {"model": "O3MIX"}, {"coder": "HUF"}, {"coder": "ARIFPAQ"}, {"model": "O9"}, {"block_size": 10}, {"model": "O1FPAQ"}])
def test_parameters_rejected(bad):
    with pytest.raises(ValueError):
        Parameters(**bad)


def _blocks(seed):
    rng = random.Random(seed)
    return [bytes(rng.choices(range(rng.choice([1, 2, 5, 256])), k=rng.randrange(400))) for _ in range(150)] + [b"a" * 5000, b"ab" * 3000, bytes(50), b"\xff" * 20, b"x" * 3000 + b"y" + b"x" * 3000, b""]


@pytest.mark.parametrize("few", [1, 12, 10**6])
def test_blocks_together_as_one_by_one(monkeypatch, few):
    """F8: many blocks sorted, and undone, in common steps."""
    data = _blocks(3)
    monkeypatch.setattr(transforms, "FEW", few)
    monkeypatch.setattr(transforms, "TOGETHER", {1: 1, 12: 1000}.get(few, 1 << 18))
    moved = transforms.bwt_all(data)
    assert moved == [transforms.bwt(b) for b in data]
    assert transforms.unbwt_all(moved) == data
    assert transforms.unbwt_all([(b"abc", 9), (b"x", 1), (b"abc", 0)]) == [None, b"x", None]
    for b, _ in moved:
        assert transforms.unmtf(transforms.mtf(b)) == b


@pytest.mark.parametrize("model", ["O0", "O1", "O2", "O3", "O0FIX"])
@pytest.mark.parametrize(("few", "most"), [(1, 65536), (32, 600), (10**6, 65536)])
def test_lanes_code_as_the_plain_coder(monkeypatch, model, few, most):
    """files side by side give the bytes of the plain coder, also where tables are halved or few lanes are left."""
    rng = random.Random(1)
    files = [[bytes(rng.choices(range(rng.choice([2, 40, 256])), k=rng.randrange(1, 300))) for _ in range(rng.randrange(4))] for _ in range(60)]
    monkeypatch.setattr(lanes, "FEW", few)
    monkeypatch.setattr(codec, "MAX_FREQ", most)
    plain = [[c.encode(b) for b in f] for f in files for c in [codec.codec_of(model)]]
    assert lanes.encode(model, files) == plain
    found = lanes.decode(model, [[(p, len(b)) for p, b in zip(x, f, strict=True)] for x, f in zip(plain, files, strict=True)])
    assert found == (files if model != "O3" else [None] * len(files))


def test_lanes_find_a_spoiled_payload():
    data = [random.Random(i).randbytes(500) for i in range(80)]
    coded = [p[0] for p in lanes.encode("O0", [[d] for d in data])]
    coded[7] = coded[7][:100]
    found = lanes.decode("O0", [[(p, 500)] for p in coded])
    assert found[7] is None and all(found[i] == [d] for i, d in enumerate(data) if i != 7)
