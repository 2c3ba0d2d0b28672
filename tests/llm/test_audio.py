import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataloom.llm import audio
from tests.llm.helpers import AWKWARD, frame


def test_wav_round_trip():
    for data in (b"", b"\x00", bytes(range(256)) * 9):
        samples = audio.padded(data)
        assert len(samples) % audio.BLOCK == 0 and len(samples) > 0
        media = audio.to_wav(samples)
        assert audio.from_wav(media) == (samples, audio.RATE)
        with wave.open(io.BytesIO(media)) as w:  # another reader agrees
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, audio.RATE) and w.readframes(len(samples)) == samples
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFF")


def test_resampling_against_direct_convolution():
    x = np.random.default_rng(0).normal(size=300).astype(np.float32)
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    taps = audio.phases().T.reshape(-1)
    full = np.convolve(up, taps)
    got = audio.Analyser().resample(x)
    best = min(np.abs(got[20:-20] - full[s : s + len(got) * audio.DOWN : audio.DOWN][: len(got)][20:-20]).max() for s in range(len(taps)))
    assert best < 1e-4
    tone = np.sin(2 * np.pi * 1000 * np.arange(24000) / audio.RATE).astype(np.float32)
    assert np.argmax(np.abs(np.fft.rfft(audio.Analyser().resample(tone)))) == 1000


def test_log_mel_finds_a_tone():
    x = (128 + 100 * np.sin(2 * np.pi * 2000 * np.arange(24000) / audio.RATE)).astype(np.uint8).tobytes()
    mels, energy = audio.Analyser().log_mel(x)
    bank = audio.mel_bank()
    assert mels.shape == (len(energy), audio.MELS) and abs(mels.mean(axis=0).argmax() - bank[int(2000 / (audio.TARGET / audio.FFT))].argmax()) <= 1


def test_hysteresis():
    energy = np.array([0, 0, 5, 1.2, 5, 0, 0, 0, 1.2, 0])
    z = (energy - energy.mean()) / energy.std()
    spans, on = [], False
    for i, v in enumerate(z):
        now = True if v >= audio.HIGH else False if v <= audio.LOW else on
        if now and not on:
            spans.append([i, None])
        if on and not now:
            spans[-1][1] = i
        on = now
    assert audio.segments(energy) == [(a, b or len(z)) for a, b in spans]


def test_tensors_and_contract(spark):
    docs = AWKWARD
    media = audio.stored_media(frame(spark, docs))
    rows = {r["doc_id"]: r for r in audio.audio_features(media).collect()}
    for i, t in docs:
        raw = (t or "").encode()
        r = rows[i]
        assert bytes(r["payload"]) == audio.padded(raw) and r["n_bytes"] == len(raw)
        assert r["media_sha256"] == hashlib.sha256(audio.to_wav(audio.padded(raw))).hexdigest() and r["media_bytes"] == len(audio.to_wav(audio.padded(raw)))
        table = pa.ipc.open_stream(bytes(r["tensors"])).read_all()
        tensors = table.column("log_mel").combine_chunks().to_numpy_ndarray()
        assert tensors.shape[1:] == (audio.CLIP, audio.MELS)
        assert table.column("start_ms").to_pylist()[0] == 0 and all(a < b for a, b in zip(table.column("start_ms").to_pylist(), table.column("end_ms").to_pylist(), strict=True))
    assert audio.audio_features(media.limit(0)).count() == 0
    assert audio.audio_features(media.limit(1).withColumn("media", F.lit(None).cast("binary"))).first()["payload"] is None
    crc = frame(spark, docs).select(F.crc32(F.expr("substring(cast(text AS binary), -32, 32)")).alias("c"), "text").where("doc_id = 7").first()
    assert crc["c"] == zlib.crc32(docs[6][1].encode()[-32:])


def test_last_bytes_touch_the_features():
    analyser = audio.Analyser()
    for blocks in (2, 3, 5, 6, 11):
        data = bytes(i * 37 % 251 for i in range(blocks * audio.BLOCK))
        one, two = (analyser.log_mel(x)[0] for x in (data, data[:-24] + bytes(255 - x for x in data[-24:])))
        assert one.shape == two.shape and not np.array_equal(one, two)


def test_resampling_in_parts_is_the_same():
    analyser = audio.Analyser()
    x = np.random.default_rng(2).standard_normal(5000).astype(np.float32)
    whole = analyser.resample(x)
    assert all(np.array_equal(whole, analyser.resample(x, at_once=n)) for n in (7, 64, 1000))
