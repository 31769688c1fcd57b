"""What the library raises, and the checks that raise it."""

from __future__ import annotations


class InvalidInput(ValueError):
    """Data or settings that an operator can't work on."""


def require(holds: bool, message: str) -> None:
    if not holds:
        raise InvalidInput(message)


def check_matrix(rows: int, width: int) -> None:
    require(rows > 0, "the table is empty")
    require(width > 0, "the table has no feature columns")


def check_clusters(k: int, rows: int) -> None:
    require(0 < k <= rows, f"k is {k}; it has to be from 1 to the number of rows, {rows}")


def check_components(components: int, rows: int, width: int) -> None:
    require(rows >= 2, "PCA needs two rows at least")
    require(0 < components <= min(rows, width), f"components is {components}; it has to be from 1 to {min(rows, width)}")


def check_tsne(rows: int, perplexity: float) -> None:
    require(rows >= 2, "t-SNE needs two rows at least")
    require(perplexity < rows, "perplexity has to be less than the number of rows")


def check_dbscan(epsilon: float, min_pts: int) -> None:
    require(epsilon > 0, "epsilon has to be more than 0")
    require(min_pts >= 2, "min_pts has to be 2 at least")


def check_fitted(model: object) -> None:
    require(model is not None, "the model isn't fitted yet")


def check_width(found: int, expected: int) -> None:
    require(found == expected, f"rows have {found} features; the model has {expected}")


def check_forgetting(factor: float) -> None:
    require(0 <= factor <= 1, f"the forgetting factor is {factor}; it has to be from 0 to 1")
