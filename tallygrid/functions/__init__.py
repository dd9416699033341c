from . import display, labels

__all__ = ["display", "labels"]
