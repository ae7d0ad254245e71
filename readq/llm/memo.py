"""What a worker remembers of texts it has met, bounded by bytes."""

from __future__ import annotations


class Memo(dict):
    """A dictionary that forgets everything when its keys take more than `room` bytes, about; so a value just set may be gone."""

    def __init__(self, room: int = 48 << 20):
        super().__init__()
        self.room, self.used = room, 0

    def __setitem__(self, key, value) -> None:
        self.used += 150 + 2 * (sum(map(len, key)) if isinstance(key, tuple) else len(key) if key is not None else 0)
        if self.used > self.room:
            self.clear()
            self.used = 0
        super().__setitem__(key, value)
