"""Writers. Each stages its output and publishes it in a last step."""
