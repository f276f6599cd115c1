"""Search for windows of other series that resemble a window of one."""
