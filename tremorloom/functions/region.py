"""Regions that events are simulated in: a square of the plane, or a polygon on the sphere. Vectorised, x east and y north."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

#: Numbers in (0, 1) for keys and the number of the draw.
Uniform = Callable[[np.ndarray, int], np.ndarray]


class Square:
    """The square from 0 to extent in both directions."""

    def __init__(self, extent: float) -> None:
        self.extent = float(extent)

    @property
    def area(self) -> float:
        return self.extent**2

    def draw(self, key: np.ndarray, uniform: Uniform) -> tuple[np.ndarray, np.ndarray]:
        return uniform(key, 1) * self.extent, uniform(key, 2) * self.extent

    def moved(self, x: np.ndarray, y: np.ndarray, distance: np.ndarray, bearing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x + distance * np.sin(bearing), y + distance * np.cos(bearing)

    def inside(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x >= 0) & (x < self.extent) & (y >= 0) & (y < self.extent)


class SphericalPolygon:
    """A polygon of (longitude, latitude) in degrees, its edges straight in these; lengths in the unit of the radius.

    Points on an edge are inside. Longitudes of the vertices may pass 180, so a polygon across the antimeridian is written without
    a jump; places are compared with them modulo 360.
    """

    def __init__(self, vertices: Sequence[tuple[float, float]], radius: float) -> None:
        ring = np.asarray(vertices, float)
        if len(ring) < 3 or radius <= 0:
            raise ValueError("a polygon needs three vertices, a sphere a positive radius")
        self.ring = ring if (ring[0] == ring[-1]).all() else np.vstack((ring, ring[:1]))
        self.radius = float(radius)
        self.west, self.east = self.ring[:, 0].min(), self.ring[:, 0].max()
        self.low, self.high = np.sin(np.radians((self.ring[:, 1].min(), self.ring[:, 1].max())))
        if self.east - self.west > 360 or abs(self.ring[:, 1]).max() > 90:
            raise ValueError("a polygon lies within 360 degrees of longitude and between the poles")

    @property
    def area(self) -> float:
        """Closed form: the integral of the sine of the latitude over longitude along the edges."""
        lon, lat = np.radians(self.ring).T
        step, rise = np.diff(lon), np.diff(lat)
        level = np.abs(rise) < 1e-12
        mean = np.where(level, np.sin(lat[:-1]), (np.cos(lat[:-1]) - np.cos(lat[1:])) / np.where(level, 1.0, rise))
        return abs(float((step * mean).sum())) * self.radius**2

    def draw(self, key: np.ndarray, uniform: Uniform, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
        """Uniform places by rejection: the tries of a key are numbered, so a place depends on the key alone."""
        x, y = np.empty(len(key)), np.empty(len(key))
        left = np.arange(len(key))
        for i in range(most):
            if not len(left):
                return x, y
            at = key[left]
            lon = self.west + uniform(at, 1000 + 2 * i) * (self.east - self.west)
            lat = np.degrees(np.arcsin(self.low + uniform(at, 1001 + 2 * i) * (self.high - self.low)))
            hit = self.inside(lon, lat)
            x[left[hit]], y[left[hit]] = (lon[hit] + 180) % 360 - 180, lat[hit]
            left = left[~hit]
        raise ValueError("the polygon has no area to draw from")

    def moved(self, x: np.ndarray, y: np.ndarray, distance: np.ndarray, bearing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places reached along great circles."""
        lat, arc = np.radians(y), distance / self.radius
        to = np.arcsin(np.clip(np.sin(lat) * np.cos(arc) + np.cos(lat) * np.sin(arc) * np.cos(bearing), -1, 1))
        turn = np.arctan2(np.sin(bearing) * np.sin(arc) * np.cos(lat), np.cos(arc) - np.sin(lat) * np.sin(to))
        return (x + np.degrees(turn) + 180) % 360 - 180, np.degrees(to)

    def inside(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = np.asarray(x, float), np.asarray(y, float)
        x = self.west + (x - self.west) % 360.0
        crossed, on = np.zeros(np.shape(x), bool), np.zeros(np.shape(x), bool)
        for (ax, ay), (bx, by) in zip(self.ring[:-1], self.ring[1:], strict=True):
            if ay != by:
                crossed ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            near = np.abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) <= 1e-12 * max(1.0, math.hypot(bx - ax, by - ay))
            on |= near & (x >= min(ax, bx) - 1e-12) & (x <= max(ax, bx) + 1e-12) & (y >= min(ay, by) - 1e-12) & (y <= max(ay, by) + 1e-12)
        return crossed | on
