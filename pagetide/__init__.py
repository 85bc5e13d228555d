"""Page-snapshot change tracking, page audit and link discovery on Spark."""
