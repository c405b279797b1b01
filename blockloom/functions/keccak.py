"""Keccak-256 with the original padding, for event topics and function selectors. Driver only: signatures are few."""

from __future__ import annotations

_MASK = (1 << 64) - 1
_RATE = 136


def _round_constants() -> list[int]:
    """By the linear feedback register of the specification."""
    out, state = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if state & 1:
                value |= 1 << ((1 << j) - 1)
            state = state << 1 ^ (0x171 if state >> 7 else 0)
        out.append(value)
    return out


_CONSTANTS = _round_constants()


def _rotate(x: int, n: int) -> int:
    n %= 64
    return (x << n | x >> (64 - n)) & _MASK if n else x


def _permute(lanes: list[list[int]]) -> None:
    for constant in _CONSTANTS:
        parity = [lanes[x][0] ^ lanes[x][1] ^ lanes[x][2] ^ lanes[x][3] ^ lanes[x][4] for x in range(5)]
        for x in range(5):
            d = parity[x - 1] ^ _rotate(parity[(x + 1) % 5], 1)
            for y in range(5):
                lanes[x][y] ^= d
        x, y, held = 1, 0, lanes[1][0]
        for t in range(24):
            x, y = y, (2 * x + 3 * y) % 5
            held, lanes[x][y] = lanes[x][y], _rotate(held, (t + 1) * (t + 2) // 2)
        for y in range(5):
            row = [lanes[x][y] for x in range(5)]
            for x in range(5):
                lanes[x][y] = row[x] ^ (~row[(x + 1) % 5] & _MASK & row[(x + 2) % 5])
        lanes[0][0] ^= constant


def keccak256(data: bytes) -> bytes:
    padded = bytearray(data + b"\x01" + bytes(-(len(data) + 1) % _RATE))
    padded[-1] |= 0x80
    lanes = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), _RATE):
        for i in range(_RATE // 8):
            lanes[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        _permute(lanes)
    return b"".join(lanes[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


def event_topic(signature: str) -> str:
    return "0x" + keccak256(signature.encode()).hex()


def selector(signature: str) -> str:
    return "0x" + keccak256(signature.encode())[:4].hex()
