"""Column-level functions (JVM expressions unless stated otherwise)."""
