"""Decoded images to fixed sizes and descriptors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.sources.store import write_counted

CHANNELS = 3
SIZE = 224
# Mean blue, green and red of the usual pretrained networks
CHANNEL_MEANS = (103.939, 116.779, 123.68)


def filter_channels(images: DataFrame, channels: int = CHANNELS) -> DataFrame:
    """Images (origin, image) with the given number of channels."""
    return images.where(F.col("image.nChannels") == channels)


def area_weights(source: int, target: int) -> np.ndarray:
    """[target, source]: the share of each source cell in each target cell."""
    edges = np.linspace(0.0, source, target + 1)
    cells = np.arange(source)
    low = np.maximum(edges[:-1, None], cells[None, :])
    high = np.minimum(edges[1:, None], cells[None, :] + 1)
    overlap = np.maximum(high - low, 0.0)
    return overlap / overlap.sum(axis=1, keepdims=True)


def resample(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average of an [h, w, c] image at another size."""
    rows = area_weights(pixels.shape[0], height)
    columns = area_weights(pixels.shape[1], width)
    return np.einsum("ij,jkc,lk->ilc", rows, pixels.astype(np.float64), columns, optimize=True)


def color_grid(pixels: np.ndarray, cells: int = 4) -> np.ndarray:
    """Mean color of each cell of a grid: the default descriptor."""
    return resample(pixels, cells, cells).ravel()


def _pixels(row) -> np.ndarray:
    flat = np.frombuffer(row.data, dtype=np.uint8)
    return flat.reshape(row.height, row.width, row.nChannels)


_RAW = ["origin", "image.height", "image.width", "image.nChannels", "image.data"]


_AT_ONCE = 32


def _map_images(
    images: DataFrame, fn: Callable[[np.ndarray], np.ndarray], out: str
) -> DataFrame:
    """(origin, out, error): ``fn`` over each image, or why its bytes could not be handled.

    Bytes that don't fit the image's shape, and a ValueError or ArithmeticError of ``fn``, are failures
    of the image; any other error is one of the program and ends the job.  Results leave the task
    ``_AT_ONCE`` images at a time, whatever their size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), _AT_ONCE):
                names, values, errors = [], [], []
                for row in batch.iloc[start : start + _AT_ONCE].itertuples(index=False):
                    value, error = None, None
                    try:
                        value = np.asarray(fn(_pixels(row)), dtype=np.float32).ravel()
                    except (ValueError, ArithmeticError) as failure:
                        error = str(failure) or type(failure).__name__
                    names.append(row.origin)
                    values.append(value)
                    errors.append(error)
                yield pd.DataFrame({"origin": names, out: values, "error": errors})

    raw = images.select(*[F.col(c).alias(c.split(".")[-1]) for c in _RAW])
    return raw.mapInPandas(run, f"origin string, {out} array<float>, error string")


def _handled(mapped: DataFrame) -> DataFrame:
    return mapped.where("error is null").drop("error")


def image_failures(
    images: DataFrame, fn: Callable[[np.ndarray], np.ndarray] = color_grid
) -> DataFrame:
    """(origin, error): the images that ``extract_features`` leaves out, with the reason."""
    return _map_images(images, fn, "vec").where("error is not null").select("origin", "error")


def prepare_images(images: DataFrame, size: int = SIZE) -> DataFrame:
    """(origin, pixels): three-channel images brought to ``size`` x ``size``, row by row."""
    return _handled(
        _map_images(filter_channels(images), lambda pixels: resample(pixels, size, size), "pixels")
    )


def write_prepared(images: DataFrame, path: str, size: int = SIZE) -> dict[str, int]:
    """Write what ``prepare_images`` gives; how many images were kept and how many failed, from the same job."""
    prepared = _map_images(
        filter_channels(images), lambda pixels: resample(pixels, size, size), "pixels"
    )
    error = F.col("error")
    return write_counted(
        prepared, path, {"kept": error.isNull(), "failed": error.isNotNull()}, keep=error.isNull()
    )


def extract_features(
    images: DataFrame, fn: Callable[[np.ndarray], np.ndarray] = color_grid
) -> DataFrame:
    """(origin, vec): a descriptor per image; ``image_failures`` has those that give none."""
    return _handled(_map_images(images, fn, "vec"))


def center_channels(pixels: Column, means: Sequence[float] = CHANNEL_MEANS) -> Column:
    """Pixel values minus the mean of their channel, channels changing fastest."""
    shift = F.array(*[F.lit(float(m)) for m in means])
    return F.transform(pixels, lambda x, i: x - F.get(shift, i % len(means)))
