"""A worker that is used again gives back the memory of earlier stages."""

from threadlens.llm import common


def resident() -> int:
    with open("/proc/self/status") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("RssAnon"))


def test_freed_memory_goes_back():
    small = [bytes(900) for _ in range(400_000)]        # many small pieces, which the allocator keeps when they are freed
    pin = [small[k] for k in range(0, len(small), 4_000)]
    del small
    before = resident()
    common.give_back()
    assert resident() <= before and len(pin) == 100
    common.give_back()                                  # nothing to give back
