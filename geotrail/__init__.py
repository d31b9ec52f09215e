"""PySpark-native engine that turns noisy, nested, time-stamped records into places, visits and journeys."""
