"""Properties of the parts that need no session."""

from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import cost_packing as P
from lattica.llm import simhash_vptree as S
from lattica.llm import slot_sharding as H
from lattica.llm import store
from lattica.llm import substring_dedup as B
from lattica.llm import telephony_audio as T


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.sampled_from([0, 4, 16]))
def test_packing_keeps_every_token_once(lengths, short):
    lengths = sorted(lengths, reverse=True)
    room, seen = defaultdict(int), defaultdict(int)
    for item, start, n, s, offset in P.packed(lengths, capacity=64, quadratic=64, short=short):
        assert start == seen[item] and offset == room[s]
        seen[item] += n
        room[s] += n
    assert [seen[i] for i in range(len(lengths))] == lengths and all(n <= 64 for n in room.values())


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 40_000))
def test_cuts_add_up(n):
    assert sum(P.cuts(n)) == n and all(0 < c <= P.CAPACITY for c in P.cuts(n))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=80), st.integers(0, 30))
def test_equal_windows_have_equal_anchors(words, at):
    w = [bytes([97 + x]) for x in words]
    h = B.word_hashes(w)
    a, r = B.anchors(h, 8, 3), B.rolling(h, 8)
    assert len(a) == len(r) == max(0, len(w) - 7)
    known = {}
    for k in range(len(a)):
        assert known.setdefault(tuple(w[k : k + 8]), (a[k], r[k])) == (a[k], r[k])
    assert len({v[1] for v in known.values()}) == len(known)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=2, max_size=200), st.integers(0, 1 << 20), st.integers(0, 3))
def test_near_points_share_a_shard(values, seed, radius):
    rng = np.random.default_rng(seed)
    x = np.array(values, dtype=np.uint64)
    y = x.copy()
    for _ in range(radius):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
    tree = S.VantageTree(np.concatenate([x, y]), 2 * len(x), 8, radius)
    of = [set() for _ in range(2 * len(x))]
    for r, s in zip(*tree.route(np.concatenate([x, y])), strict=True):
        of[r].add(int(s))
    assert all(of[i] & of[len(x) + i] for i in range(len(x)))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=40))
def test_local_roots_are_components(pairs):
    m = np.eye(20, dtype=bool)
    for a, b in pairs:
        m[a, b] = m[b, a] = True
    reach = np.linalg.matrix_power(m.astype(float), 20) > 0
    assert store.local_roots(m).tolist() == [int(np.flatnonzero(row)[0]) for row in reach]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=700), st.sampled_from([T.MULAW, T.ALAW, T.IMA]))
def test_any_bytes_survive_any_codec(text, codec):
    payload = T.padded(text)
    tag, _, blocks = T.opened(T.stored(payload, codec))
    assert T.payload_of(tag, blocks) == payload and payload.startswith(text)
    # a block of IMA begins with a sample in its header
    assert len(T.decoded([(tag, blocks)])[0]) == (2 * len(payload) + len(blocks) if codec == T.IMA else len(payload))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=64, max_size=64), st.integers(1, 6))
def test_rebalancing_only_moves_slots_to_new_shards(loads, more):
    held = dict(enumerate(loads))
    first = H.SlotMap.first(held, 64, 4)
    second = first.rebalanced(held, 4 + more)
    assert all(b == a or b >= 4 for a, b in zip(first.owner, second.owner, strict=True))
