"""streaming of the media-stream library."""
