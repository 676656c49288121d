"""Resampling, mel filters, segments and stored tensors against plain forms of them."""

from __future__ import annotations

import numpy as np


def test_resampling_equals_zero_stuffing_and_filtering():
    from kelpie.llm.audio import low_pass, resample

    r = np.random.default_rng(1)
    for up, down, taps, n in ((3, 8, 24, 1000), (2, 3, 16, 257), (1, 2, 24, 64), (3, 8, 24, 5)):
        x = r.normal(0, 1, n).astype(np.float32)
        h = low_pass(up, down, taps)
        stuffed = np.zeros(n * up)
        stuffed[::up] = x
        full = np.convolve(stuffed, h)
        full = np.concatenate([full, np.zeros(up * taps)])
        want = full[(taps // 2) * up :][: n * up : down][: -(-n * up // down)]
        got = resample(x, up, down, taps)
        assert len(got) == -(-n * up // down) and np.allclose(got, want, atol=1e-4)
        for a, b in ((0, len(got) // 2), (len(got) // 3, len(got)), (7, 9)):
            assert np.allclose(resample(x, up, down, taps, a, b), got[a:b], atol=1e-6)


def test_a_tone_keeps_its_pitch_and_lies_in_its_filter():
    from kelpie.llm.audio import DOWN, MELS, RATE, UP, log_mel, mel_filters, resample

    rate = RATE * UP / DOWN
    for hz in (300, 700, 1200):
        x = np.sin(2 * np.pi * hz * np.arange(RATE) / RATE).astype(np.float32)
        y = resample(x)[200:-200]
        peak = np.argmax(np.abs(np.fft.rfft(y))) * rate / len(y)
        assert abs(peak - hz) < 5
        best = int(np.argmax(log_mel(y, rate).mean(0)))
        f = mel_filters(rate)
        assert f.shape[1] == MELS and (f >= 0).all() and f[:, best].argmax() * rate / 128 - hz < 120
    loud = resample(np.sin(2 * np.pi * 3500 * np.arange(RATE) / RATE).astype(np.float32))
    assert np.abs(loud[200:-200]).max() < 0.05  # beyond the new rate's half nothing is left


def test_blocks_equal_the_whole(monkeypatch):
    from kelpie.llm import audio

    samples = np.random.default_rng(2).integers(0, 256, 40_000, dtype=np.uint8)
    rate = audio.RATE * audio.UP / audio.DOWN
    whole = audio.log_mel(audio.resample((samples.astype(np.float32) - 128) / 128), rate)
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 7)
    parts = np.concatenate(list(audio.mel_blocks(samples, rate)))
    assert parts.shape == whole.shape and np.allclose(parts, whole, atol=1e-3)
    assert audio.features(bytes(64), 8000)[2].startswith("frames=1;")


def test_hysteresis():
    from kelpie.llm.audio import hysteresis

    e = np.array([0, 2, 5, 2, 0, 2, 2, 0, 6, 0, 3])
    assert hysteresis(e, 4, 1) == [(1, 4), (8, 9)]
    assert hysteresis(np.zeros(0), 4, 1) == []


def test_tensors_are_stored_with_their_spans(spark):
    from kelpie.llm.audio import HOP, MELS, TILE_FRAMES, audio_features, from_wav, log_mel, read_tensors, resample, store_media

    text = "some text " * 900
    got = audio_features(store_media(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))).collect()
    row = next(r for r in got if r.doc_id == 1)
    spans, tensors = read_tensors(bytes(row.tensors))
    assert tensors.dtype == np.float16 and tensors.shape[1:] == (TILE_FRAMES, MELS)
    media = next(r.media for r in store_media(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())
    samples, rate = from_wav(bytes(media))
    mel = log_mel(resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128), rate * 3 / 8)
    assert np.allclose(tensors.reshape(-1, MELS)[: len(mel)], mel, atol=0.02)
    assert spans[0, 0] == 0 and np.allclose(spans[1:, 0], spans[:-1, 1]) and abs(spans[-1, 1] - len(mel) * 1000 * HOP * 8 / (rate * 3)) < 1e-6
    assert all(s.start_ms < s.end_ms for s in row.segments)
