from slotwise.functions import arrays, labels, timeparts

__all__ = ["arrays", "labels", "timeparts"]
