"""Spark-native point analytics: tables of numeric points, scaled, grouped, scored and watched."""
