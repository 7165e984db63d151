"""sources of the media-stream library."""
