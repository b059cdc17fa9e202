"""The rules and chains that come with the library."""

from __future__ import annotations

from .model import parse_chain, parse_rule

# Ids, severities, techniques, criteria and allow lists of the atomic rules.
_RULES = [
    {'id': 'LNX-001',
     'name': 'Script fetched by a download tool',
     'platform': 'linux',
     'severity': 'high',
     'mitre_attack': ['T1105', 'T1059.004'],
     'detection': {'command_regex': '(curl|wget).*(http://|https://|ftp://).*\\.(sh|pl|py|rb)'},
     'whitelist': {'users': ['root'], 'paths': ['/var/lib/apt', '/usr/lib/update-manager']}},
    {'id': 'LNX-002',
     'name': 'Shell wired to a network device',
     'platform': 'linux',
     'severity': 'critical',
     'mitre_attack': ['T1059.004', 'T1071.001'],
     'detection': {'command_regex': '(bash|sh|nc|ncat).*(>|<).*/(tcp|udp|dev)|/bin/(ba)?sh.*0<&1|exec.*/(tcp|udp)'}},
    {'id': 'LNX-003',
     'name': 'User crontab edited',
     'platform': 'linux',
     'severity': 'high',
     'mitre_attack': ['T1053.003'],
     'detection': {'process_name': 'crontab', 'command_contains': ['-e']},
     'whitelist': {'users': ['root']}},
    {'id': 'LNX-004',
     'name': 'SSH tunnel or proxy options',
     'platform': 'linux',
     'severity': 'medium',
     'mitre_attack': ['T1021.004', 'T1572'],
     'detection': {'process_name': 'ssh', 'command_regex': 'ssh.*(\\s-[DLR]\\s|ProxyCommand|\\s-o\\s)'}},
    {'id': 'LNX-005',
     'name': 'Decoded base64 handed to a shell',
     'platform': 'linux',
     'severity': 'high',
     'mitre_attack': ['T1027', 'T1059.004'],
     'detection': {'command_regex': 'base64\\s+-d.*\\||echo.*base64.*\\|.*(bash|sh)'}},
    {'id': 'LNX-006',
     'name': 'Netcat in listening mode',
     'platform': 'linux',
     'severity': 'high',
     'mitre_attack': ['T1071', 'T1059.004'],
     'detection': {'process_name': 'nc', 'command_contains': ['-l']}},
    {'id': 'LNX-007',
     'name': 'Python one-liner with a duplicated socket',
     'platform': 'linux',
     'severity': 'critical',
     'mitre_attack': ['T1059.006'],
     'detection': {'command_contains': ['socket', 'dup2', 'subprocess'],
                   'command_contains_any': ['python -c', 'python3 -c', 'python2 -c'],
                   'command_regex': '(?i)python[0-9.]*\\s+-c\\s+.*socket.*dup2.*subprocess'},
     'whitelist': {'parent_processes': ['security-test-runner'], 'users': ['redteam'], 'paths': ['/opt/company/security-tests/']}},
    {'id': 'LNX-008',
     'name': 'Service unit placed by a shell tool',
     'platform': 'linux',
     'severity': 'high',
     'mitre_attack': ['T1543.002'],
     'detection': {'command_contains_any': ['/etc/systemd/system/', '/usr/lib/systemd/system/', '/lib/systemd/system/'],
                   'command_regex': '(?i)(echo|printf|tee|cp|mv|install|cat|curl|wget|dd).*(/etc/systemd/system/|/usr/lib/systemd/system/|/lib/systemd/system/).+\\.service'},
     'whitelist': {'parent_processes': ['dpkg', 'rpm', 'ansible-playbook', 'puppet', 'salt-call'], 'users': ['svc_configuration'], 'paths': ['/opt/company/systemd/']}},
    {'id': 'LNX-009',
     'name': 'Preloaded library from a writable folder',
     'platform': 'linux',
     'severity': 'high',
     'mitre_attack': ['T1574.006'],
     'detection': {'command_contains': ['LD_PRELOAD='],
                   'command_contains_any': ['/tmp/', '/var/tmp/', '/dev/shm/', '/run/user/'],
                   'command_regex': '(?i)LD_PRELOAD\\s*=\\s*[^ ]*(/tmp/|/var/tmp/|/dev/shm/|/run/user/)[^ ]+\\.so'},
     'whitelist': {'parent_processes': ['gdb', 'rr', 'valgrind'], 'users': ['svc_build'], 'paths': ['/opt/company/testing/preload/']}},
    {'id': 'LNX-010',
     'name': 'SSH authorized keys changed',
     'platform': 'linux',
     'severity': 'high',
     'mitre_attack': ['T1098.004'],
     'detection': {'command_contains': ['authorized_keys'],
                   'command_contains_any': ['echo ', 'printf ', 'tee ', 'cat ', 'curl ', 'wget ', 'cp ', 'sed '],
                   'command_regex': '(?i)(echo|printf|tee|cat|curl|wget|cp|sed).*(/\\.ssh/authorized_keys|\\.ssh/authorized_keys)'},
     'whitelist': {'parent_processes': ['ansible-playbook', 'puppet', 'salt-call', 'cloud-init'],
                   'users': ['svc_configuration'],
                   'paths': ['/opt/company/ssh-key-management/']}},
    {'id': 'LNX-011',
     'name': 'Download run at once',
     'platform': 'linux',
     'severity': 'high',
     'mitre_attack': ['T1105', 'T1059.004'],
     'detection': {'command_contains': ['wget'],
                   'command_contains_any': ['| bash', '| sh', '|bash', '|sh', '/tmp/', '/var/tmp/', '/dev/shm/'],
                   'command_regex': '(?i)wget\\s+.*(\\|\\s*(ba)?sh|(/tmp/|/var/tmp/|/dev/shm/).*(chmod|bash|sh|python|perl|\\./))'},
     'whitelist': {'parent_processes': ['gitlab-runner', 'jenkins', 'company-bootstrap'], 'users': ['svc_ci'], 'paths': ['/opt/company/bootstrap/']}},
    {'id': 'MAC-001',
     'name': 'AppleScript starting a shell',
     'platform': 'macos',
     'severity': 'high',
     'mitre_attack': ['T1059.002', 'T1059.004'],
     'detection': {'process_name': 'osascript', 'command_contains': ['do shell script']},
     'whitelist': {'parent_processes': ['munki', 'jamf'], 'users': ['_mbsetupuser'], 'paths': ['/Library/Company/Automation/']}},
    {'id': 'MAC-002',
     'name': 'Download piped into a shell',
     'platform': 'macos',
     'severity': 'high',
     'mitre_attack': ['T1105', 'T1059.004'],
     'detection': {'command_regex': '(?i)(curl|wget)\\s+.*(https?://).*(\\.sh(\\s|$)|\\|\\s*(ba|z)?sh)'},
     'whitelist': {'parent_processes': ['Terminal'], 'users': ['admin'], 'paths': ['/opt/company/bootstrap/']}},
    {'id': 'MAC-003',
     'name': 'Launch item enabled',
     'platform': 'macos',
     'severity': 'high',
     'mitre_attack': ['T1543.001', 'T1543.004'],
     'detection': {'process_name': 'launchctl',
                   'command_contains_any': ['LaunchAgents', 'LaunchDaemons'],
                   'command_regex': '(?i)(load|bootstrap|enable).*/(LaunchAgents|LaunchDaemons)/.*\\.plist'},
     'whitelist': {'parent_processes': ['installer', 'jamf'], 'users': ['root'], 'paths': ['/Library/Company/Agents/']}},
    {'id': 'MAC-004',
     'name': 'Gatekeeper switched off',
     'platform': 'macos',
     'severity': 'critical',
     'mitre_attack': ['T1553.001'],
     'detection': {'process_name': 'spctl', 'command_contains': ['--master-disable']},
     'whitelist': {'users': ['_developer'], 'paths': ['/opt/company/dev-provisioning/']}},
    {'id': 'MAC-005',
     'name': 'Local account made by dscl',
     'platform': 'macos',
     'severity': 'high',
     'mitre_attack': ['T1136.001'],
     'detection': {'process_name': 'dscl', 'command_contains': ['-create'], 'command_contains_any': ['/Users/', 'UserShell', 'RealName']},
     'whitelist': {'parent_processes': ['jamf', 'munki'], 'paths': ['/opt/company/provisioning/']}},
    {'id': 'MAC-007',
     'name': 'Sudoers file changed',
     'platform': 'macos',
     'severity': 'high',
     'mitre_attack': ['T1548.003'],
     'detection': {'command_contains_any': ['/etc/sudoers'], 'command_regex': '(?i)(tee|cp|mv|install|dd|printf|echo|sed)\\s+.*/etc/sudoers(\\.d)?'},
     'whitelist': {'parent_processes': ['jamf', 'ansible-playbook', 'munki'], 'paths': ['/opt/company/provisioning/']}},
    {'id': 'WIN-001',
     'name': 'Certutil used as downloader',
     'platform': 'windows',
     'severity': 'high',
     'mitre_attack': ['T1105', 'T1140'],
     'detection': {'process_name': 'certutil.exe', 'command_contains': ['-urlcache', 'http']},
     'whitelist': {'parent_processes': ['msiexec.exe', 'sccm.exe'], 'users': ['SYSTEM']}},
    {'id': 'WIN-002',
     'name': 'Encoded PowerShell command',
     'platform': 'windows',
     'severity': 'high',
     'mitre_attack': ['T1059.001', 'T1027'],
     'detection': {'process_name': 'powershell.exe', 'command_contains_any': ['-encodedcommand', '-enc', '-EncodedCommand', '-e ']},
     'whitelist': {'parent_processes': ['sccm.exe', 'psexec.exe', 'solarwinds.exe'],
                   'users': ['SYSTEM'],
                   'paths': ['C:\\Program Files\\Microsoft Monitoring Agent', 'C:\\Program Files\\SCCM']}},
    {'id': 'WIN-003',
     'name': 'Remote process by WMI',
     'platform': 'windows',
     'severity': 'high',
     'mitre_attack': ['T1047', 'T1021'],
     'detection': {'process_name': 'wmic.exe', 'command_contains_any': ['process call create', '/node:', 'node:', 'PROCESS CALL CREATE']},
     'whitelist': {'parent_processes': ['sccm.exe', 'manageengine.exe', 'ansible.exe'],
                   'users': ['svc_deployment', 'svc_monitoring'],
                   'paths': ['C:\\Program Files\\Microsoft System Center']}},
    {'id': 'WIN-004',
     'name': 'Scriptlet through regsvr32',
     'platform': 'windows',
     'severity': 'high',
     'mitre_attack': ['T1218.010', 'T1218'],
     'detection': {'process_name': 'regsvr32.exe', 'command_contains_any': ['/s /i:http', '/i:http', 'scrobj.dll', '/s /u /i:http', '.sct']},
     'whitelist': {'parent_processes': ['msiexec.exe', 'setup.exe', 'installer.exe'], 'users': ['SYSTEM'], 'paths': ['C:\\Program Files', 'C:\\Program Files (x86)']}},
    {'id': 'WIN-005',
     'name': 'BITS transfer from the command line',
     'platform': 'windows',
     'severity': 'high',
     'mitre_attack': ['T1197', 'T1105'],
     'detection': {'process_name': 'bitsadmin.exe', 'command_contains': ['/transfer', 'http']},
     'whitelist': {'parent_processes': ['services.exe', 'svchost.exe', 'wsus.exe'], 'users': ['SYSTEM', 'NETWORK SERVICE'], 'paths': ['C:\\Windows\\System32\\Tasks']}},
    {'id': 'WIN-006',
     'name': 'Script run by mshta',
     'platform': 'windows',
     'severity': 'medium',
     'mitre_attack': ['T1218.005', 'T1059'],
     'detection': {'process_name': 'mshta.exe', 'command_contains_any': ['http', 'https', 'vbscript', 'javascript', '.hta', 'about:']},
     'whitelist': {'parent_processes': ['explorer.exe', 'setup.exe'], 'users': ['SYSTEM'], 'paths': ['C:\\Program Files', 'C:\\Windows\\Installer']}},
    {'id': 'WIN-007',
     'name': 'PowerShell web client cradle',
     'platform': 'windows',
     'severity': 'high',
     'mitre_attack': ['T1059.001', 'T1105'],
     'detection': {'process_name': 'powershell.exe', 'command_contains': ['Net.WebClient', 'DownloadString'], 'command_contains_any': ['IEX', 'Invoke-Expression']},
     'whitelist': {'parent_processes': ['DeployAgent.exe'], 'users': ['svc_automation'], 'paths': ['C:\\ProgramData\\Company\\Deployment\\']}},
    {'id': 'WIN-008',
     'name': 'Script through rundll32',
     'platform': 'windows',
     'severity': 'high',
     'mitre_attack': ['T1218.011'],
     'detection': {'process_name': 'rundll32.exe', 'command_regex': '(?i)javascript\\s*:\\s*.*mshtml\\s*,\\s*RunHTMLApplication'},
     'whitelist': {'parent_processes': ['SecurityTestHarness.exe'], 'users': ['svc_redteam'], 'paths': ['C:\\Program Files\\Company\\SecurityTests\\']}},
    {'id': 'WIN-010',
     'name': 'Remote package by msiexec',
     'platform': 'windows',
     'severity': 'high',
     'mitre_attack': ['T1218.007', 'T1105'],
     'detection': {'process_name': 'msiexec.exe', 'command_contains_any': ['http://', 'https://'], 'command_regex': '(?i)(?:^|\\s)(?:/i|/package)\\s+https?://'},
     'whitelist': {'parent_processes': ['CcmExec.exe', 'CompanySoftwareCenter.exe'], 'users': ['svc_deployment'], 'paths': ['C:\\ProgramData\\Company\\Packages\\']}},
    {'id': 'WIN-011',
     'name': 'Profile from a writable folder by cmstp',
     'platform': 'windows',
     'severity': 'high',
     'mitre_attack': ['T1218.003'],
     'detection': {'process_name': 'cmstp.exe',
                   'command_contains': ['/s'],
                   'command_contains_any': ['\\AppData\\', '\\Downloads\\', '\\Temp\\', 'C:\\Users\\Public\\'],
                   'command_regex': '(?i)(?:\\\\AppData\\\\|\\\\Downloads\\\\|\\\\Temp\\\\|C:\\\\Users\\\\Public\\\\).+\\.inf(?:\\s|$)'},
     'whitelist': {'parent_processes': ['CompanyVpnInstaller.exe'], 'users': ['svc_vpn_deploy'], 'paths': ['C:\\ProgramData\\Company\\VPN\\']}},
]

# Ids, windows and stages of the chains.
_CHAINS = [
    {'id': 'CHAIN-LNX-001',
     'name': 'Web server to shell to download',
     'platform': 'linux',
     'severity': 'critical',
     'mitre_attack': ['T1190', 'T1059.004', 'T1105'],
     'window_seconds': 600,
     'stages': [{'name': 'web_server_parent', 'match': {'process_name_any': ['nginx', 'apache2', 'httpd', 'php-fpm', 'tomcat', 'java', 'node', 'gunicorn', 'uwsgi']}},
                {'name': 'spawned_shell', 'relation': 'descendant', 'match': {'process_name_any': ['sh', 'bash', 'dash']}},
                {'name': 'payload_retrieval',
                 'relation': 'descendant',
                 'match': {'process_name_any': ['curl', 'wget', 'python', 'python3', 'nc', 'ncat'],
                           'command_contains_any': ['http://', 'https://', 'ftp://', '-c ', '-e ']}}]},
    {'id': 'CHAIN-LNX-002',
     'name': 'Scheduled shell fetching a file',
     'platform': 'linux',
     'severity': 'high',
     'mitre_attack': ['T1053.003', 'T1059.004', 'T1105'],
     'window_seconds': 120,
     'stages': [{'name': 'cron_parent', 'match': {'process_name_any': ['cron', 'crond', 'anacron']}},
                {'name': 'cron_shell', 'relation': 'descendant', 'match': {'process_name_any': ['sh', 'bash', 'dash']}},
                {'name': 'remote_fetch', 'relation': 'descendant', 'match': {'process_name_any': ['curl', 'wget'], 'command_contains_any': ['http://', 'https://']}}]},
    {'id': 'CHAIN-MAC-001',
     'name': 'AppleScript to shell to download',
     'platform': 'macos',
     'severity': 'critical',
     'mitre_attack': ['T1059.002', 'T1059.004', 'T1105'],
     'window_seconds': 300,
     'stages': [{'name': 'osascript_parent', 'match': {'process_name': 'osascript'}},
                {'name': 'spawned_shell', 'relation': 'descendant', 'match': {'process_name_any': ['sh', 'bash', 'zsh']}},
                {'name': 'payload_download',
                 'relation': 'descendant',
                 'match': {'process_name_any': ['curl', 'wget'], 'command_contains_any': ['http://', 'https://', 'ftp://']}}]},
    {'id': 'CHAIN-WIN-001',
     'name': 'Office program to hidden shell',
     'platform': 'windows',
     'severity': 'critical',
     'mitre_attack': ['T1566.001', 'T1059.001', 'T1027'],
     'window_seconds': 300,
     'stages': [{'name': 'office_parent', 'match': {'process_name_any': ['winword.exe', 'excel.exe', 'powerpnt.exe', 'outlook.exe', 'msaccess.exe', 'mspub.exe']}},
                {'name': 'obfuscated_shell_child',
                 'relation': 'descendant',
                 'match': {'process_name_any': ['powershell.exe', 'pwsh.exe', 'cmd.exe'],
                           'command_contains_any': ['-encodedcommand',
                                                    '-enc ',
                                                    'frombase64string',
                                                    'downloadstring',
                                                    'downloadfile',
                                                    'invoke-expression',
                                                    'iex ',
                                                    'hidden']}}]},
    {'id': 'CHAIN-WIN-002',
     'name': 'Script host to download tool',
     'platform': 'windows',
     'severity': 'high',
     'mitre_attack': ['T1059.005', 'T1218', 'T1105'],
     'window_seconds': 300,
     'stages': [{'name': 'script_host_parent', 'match': {'process_name_any': ['wscript.exe', 'cscript.exe', 'mshta.exe']}},
                {'name': 'lolbin_downloader',
                 'relation': 'descendant',
                 'match': {'process_name_any': ['certutil.exe', 'bitsadmin.exe', 'curl.exe'],
                           'command_contains_any': ['urlcache', '-split', '/transfer', 'http://', 'https://']}}]},
]

RULES = [parse_rule(d) for d in _RULES]
CHAINS = [parse_chain(d) for d in _CHAINS]
